"""N-gram Jaccard join: prefix filtering in rare-first order, one check per pair.

Two documents link when the Jaccard similarity of their word n-gram sets reaches a
threshold. The plan:

1. One pass over the texts gives each document's set size and a signature of the
   set, and counts n-grams into a fixed number of buckets. Documents with equal
   sets are one *node* from here on, so copies never meet as pairs.
2. A second pass orders each set by (bucket count, hash), a global order in which
   common n-grams come last, and emits its prefix: the n-grams of which any
   partner must share one. Each task emits a node once.
3. Rows of one n-gram meet. Every row is paired with the smallest node of its
   n-gram only (star candidates), after length and positional filters, and of its
   candidates a node tries the one it meets most often. A pair passes the suffix filter
   and then fetches whole sets, once.
4. Links found are contracted to components. N-grams whose rows still lie in
   different components try further stars, with leaders drawn at random, one
   candidate a node and turn (the nearest by the parities below), until hardly a pair
   links. Only what is then still apart is paired in full, across components, without
   the pairs that were checked before. A pair comes up at the n-grams that it shares
   first, not at each. Of the pairs between two components the nearest is checked
   first, the others only where that left them apart. No link between components is
   lost.

The suffix filter bounds how far two sets differ by their hash ranges: each node
carries the parity of its n-grams in each of 256 ranges, and every range whose parities
differ holds an n-gram of one set only.

An n-gram far above the bucket mean is dealt out over salted subgroups, whose
leaders then meet; no task gets a group that grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, remove, shared_path, stored
from .components import components

BUCKET_BITS = 18
CHUNK = 4096
#: Rows of one n-gram that a task takes before the n-gram is salted.
GROUP_ROWS = 20_000
#: Pairs with both their sets that go to Python at a time: a set takes 8 bytes an n-gram, and a
#: batch is held by the JVM, while it grows twice over, and by the worker.
SET_ROWS = 200
#: Words and signatures that a task remembers before it starts afresh.
MEMO = 200_000
#: Turns of star candidates with drawn leaders, and leaders of an n-gram in each. They only
#: save work: what they leave apart is paired in full.
STAR_TURNS, LEADERS = 4, 4
#: A turn of whose pairs less than this share link is the last one: what is open
#: then is mostly texts that share n-grams but are not alike, which stars do not contract.
WORTH = 0.1
#: Earlier n-grams of its node that a row of the full search knows.
BEFORE = 4
#: Turns of the full search that check one pair of two components, while over FEW_PAIRS are
#: left. They only save work, too.
NEAREST_TURNS, FEW_PAIRS = 3, 5_000
#: Hash ranges whose parities each node carries for the suffix filter, 64 to a number.
RANGES = 256
SIGNS = [f"g{i}" for i in range(RANGES // 64)]
#: Rows on either side of a cell of the grid over the rows of one n-gram and length band.
PAIRED_ROWS = 20_000
#: Copies of a row that many rows of one node or root are dealt to.
SALTS = 8
#: Nodes with one 64-bit hash for different sets that can be told apart; about one is due at 6e9 sets.
CLASHES = 10_000
#: Bits of the filter that tells which documents a check needs; a full filter only
#: lets more sets through to the exact join.
FILTER_BITS, PIECE_BITS = 1 << 24, 1 << 15
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams. ``bytes.lower`` and
    ``bytes.split`` are exactly A-Z and ``[\\x20\\x09-\\x0D]``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    span = max(1, len(a) - n + 1)
    h = np.zeros(span, np.uint64)
    for k in range(min(n, len(a))):
        h = h * _P + a[k : k + span]
    h ^= h >> np.uint64(32)
    h *= _M
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _sets(batches: Iterator[pa.RecordBatch], n: int, clashes: frozenset = frozenset()):
    """(doc, set, node, check): a set's hash, half of 128 bits, and the other half, which
    takes its place where the first half is known to stand for different sets."""
    memo = _Memo()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingle_set(text.as_py(), n, memo)
            both = xxhash.xxh3_128_intdigest(s.tobytes())
            node, check = _signed(both & (1 << 64) - 1), _signed(both >> 64)
            yield doc, s, (check if node in clashes else node), check


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: (doc_id, n, node, check, parities) of every document; kind 1: bucket counts of a task."""

    def run(batches):
        let_go()
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        rows: list[tuple] = []

        def out(kind, ids, ns, nodes, checks, signs, counted):
            numbers = [pa.array(x, pa.int64()) for x in (ids, ns, nodes, checks, *signs)]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.int32()), *numbers, pa.array(counted, pa.binary())], ["kind", "doc_id", "n", "node", "check", *SIGNS, "counts"])

        def documents():
            ids, ns, nodes, checks, bits = zip(*rows, strict=True)
            signs = np.ascontiguousarray(np.stack(bits).view(np.int64).T)
            rows.clear()
            return out(0, ids, ns, nodes, checks, signs, [None] * len(ids))

        for doc, s, node, check in _sets(batches, n):
            np.add.at(counts, (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            odd = np.bincount((s >> np.uint64(32) & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES) & 1
            rows.append((doc, len(s), node, check, np.packbits(odd.astype(bool))))
            if len(rows) >= 5_000:
                yield documents()
        if rows:
            yield documents()
        if counts.any():
            k = len(counts) // CHUNK
            none = [None] * k
            yield out(1, none, range(k), none, none, [none] * len(SIGNS), [counts[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in range(k)])

    return docs.mapInArrow(run, f"kind int, doc_id long, n long, node long, check long, {', '.join(f'{g} long' for g in SIGNS)}, counts binary")


def _bucket_counts(survey: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts: a table of fixed size (2 MB) whatever the corpus."""

    def add(pdf):
        total = np.sum([np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["counts"]], axis=0)
        return pdf.head(1)[["n"]].assign(counts=[total.tobytes()])

    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in survey.filter("kind = 1").groupBy("n").applyInPandas(add, "n long, counts binary").collect():
        counts[r["n"] * CHUNK : (r["n"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return counts


def _prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray, clashes: frozenset) -> DataFrame:
    mean = counts.mean()
    excess = counts - mean - 6 * np.sqrt(mean)
    parts = np.maximum(1, np.ceil(excess / GROUP_ROWS)).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((counts, parts))

    def run(batches):
        let_go()
        counts, parts = shared.value
        seen: set[int] = set()
        held: list[tuple] = []

        def out():
            h, b, size, pos, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            p = parts[b]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.where(p > 1, nodes % p, -1).astype(np.int32)), pa.array(nodes), pa.array(size.astype(np.int32)), pa.array(pos.astype(np.int32))], ["h", "salt", "node", "n", "pos"])

        rows = 0
        for doc, s, node, _ in _sets(batches, n, clashes):
            if not len(s) or doc is None or node in seen:
                continue
            if len(seen) >= MEMO:
                seen.clear()
            seen.add(node)
            b = (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            keep = len(s) - -(-percent * len(s) // 100) + 1
            order = np.lexsort((s, counts[b]))[:keep]
            held.append((s[order], b[order], np.full(keep, len(s)), np.arange(keep), np.full(keep, node)))
            rows += keep
            if rows >= 200_000:
                yield out()
                rows = 0
        if held:
            yield out()

    return docs.mapInArrow(run, "h long, salt int, node long, n int, pos int")


def _may_link(a: str, b: str, percent: int):
    """Length and positional filter at a shared n-gram; a and b prefix the columns.

    At a pair's first shared n-gram nothing before it is shared, so the overlap is at
    most what is left from there on. Rows of later n-grams may fail where the first
    passes, and a pair needs one row.
    """
    na, nb, pa_, pb = (F.col(f"{x}{c}").cast("long") for c, x in (("n", a), ("n", b), ("pos", a), ("pos", b)))
    length = F.greatest(na, nb) * percent <= F.least(na, nb) * 100
    return length & ((100 + percent) * F.least(na - pa_, nb - pb) >= percent * (na + nb))


def _apart(a: str, b: str):
    """Ranges with different parities, and the n-grams of both sets."""
    both = F.col(f"{a}n").cast("long") + F.col(f"{b}n")
    return sum((F.bit_count(F.col(f"{a}{g}").bitwiseXOR(F.col(f"{b}{g}"))) for g in SIGNS[1:]), F.bit_count(F.col(f"{a}{SIGNS[0]}").bitwiseXOR(F.col(f"{b}{SIGNS[0]}")))), both


def _suffix(a: str, b: str, percent: int):
    """Suffix filter: ranges with different parities are n-grams that only one set has."""
    apart, both = _apart(a, b)
    return (100 + percent) * (both - apart) >= 2 * percent * both


def _far(a: str, b: str):
    """How far two sets seem to be apart, in thousandths."""
    apart, both = _apart(a, b)
    return F.floor(1000 * apart / both).cast("int").alias("far")


def _suffix_filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}{c}") for c in ("n", *SIGNS)])
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_suffix("a", "b", percent)).select("a", "b")


def _needed_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, clashes: frozenset) -> DataFrame:
    """(node, set) of one document for each node in ``pairs``."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rep = nodes.select("node", "doc_id").join(needed, "node", "left_semi")
    # Bits are set in pieces of 4 KB, merged by piece: FILTER_BITS in all, whatever the corpus. Texts
    # that no pair needs are left out before they go to Python.
    spot = F.xxhash64("doc_id").bitwiseAND(F.lit(FILTER_BITS - 1))
    place = F.col("spot").bitwiseAND(F.lit(PIECE_BITS - 1))
    pieces = rep.select(spot.alias("spot")).groupBy(F.shiftright("spot", 15).alias("piece")).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1
    rows = docs.withColumn("spot", spot).withColumn("piece", F.shiftright("spot", 15)).join(F.broadcast(pieces), "piece").filter(hit)

    def run(batches):
        let_go()
        seen = set()
        for batch in batches:
            out = ([], [])
            for _, s, node, _ in _sets([batch], n, clashes):
                if node not in seen:
                    seen.add(node) if len(seen) < MEMO else seen.clear()
                    out[0].append(node)
                    out[1].append(s.tobytes())
            for i in range(0, len(out[0]), 500):
                yield pa.RecordBatch.from_arrays([pa.array(out[0][i : i + 500], pa.int64()), pa.array(out[1][i : i + 500], pa.binary())], ["node", "s"])

    return rows.select("doc_id", "text").mapInArrow(run, "node long, s binary").join(needed, "node", "left_semi").dropDuplicates(["node"])


def _checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int, clashes: frozenset) -> DataFrame:
    """The pairs (a, b) that link by their whole sets."""
    left = stored(pairs, "jaccard-left")
    # Both joins read the one shuffle by node that leaves a set once.
    sets = _needed_sets(docs, nodes, left, n, clashes)
    both = left.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        return (100 + percent) * len(np.intersect1d(x, y, assume_unique=True)) >= percent * (len(x) + len(y))

    def run(batches):
        let_go()
        for batch in batches:
            _, _, sa, sb = batch.columns
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(sa, sb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _likeliest(rows: DataFrame) -> DataFrame:
    """Of the candidates (a, b) of each node ``a``, the one it meets at most n-grams."""
    met = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("a").agg(F.max(F.struct("n", "b")).alias("x")).select("a", "x.b")


def _nearest(rows: DataFrame) -> DataFrame:
    """Of the candidates (a, b, far) of each node ``a``, the one that seems nearest."""
    return rows.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select("a", "x.b")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their components, of n-grams that lie in several components."""
    named = rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    w = Window.partitionBy("h")
    return named.withColumns({"x": F.min("root").over(w), "y": F.max("root").over(w)}).filter("x != y").drop("x", "y")


def _stars(open_rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Candidates (a, b, far) between each row and LEADERS nodes of its n-gram, drawn anew for
    each n-gram and turn, where components differ: a node meets other leaders at each of its
    n-grams. The draw is a group-wise minimum; it and the join read one shuffle by n-gram."""
    open_rows = open_rows.repartition("h")
    fields = ["node", "n", "pos", "root", *SIGNS]
    lead = lambda k: F.min(F.struct(F.xxhash64(F.lit(turn * LEADERS + k), "h", "node").alias("draw"), *[F.col(c).alias(f"l{c}") for c in fields])).alias(f"x{k}")
    leads = open_rows.groupBy("h").agg(*[lead(k) for k in range(LEADERS)])
    each = F.array(*[F.struct(*[F.col(f"x{k}.l{c}") for c in fields]) for k in range(LEADERS)])
    leads = leads.select("h", F.explode(F.array_distinct(each)).alias("x")).select("h", "x.*")
    near = open_rows.join(leads, "h").filter((F.col("root") != F.col("lroot")) & _may_link("", "l", percent) & _suffix("", "l", percent))
    return near.select(F.col("node").alias("a"), F.col("lnode").alias("b"), _far("", "l"))


def _across(open_rows: DataFrame, percent: int) -> DataFrame:
    """All candidates (a, b, far) between components that pass the filters, inside the join.

    Each row knows the ``BEFORE`` n-grams that stand before its own in its node. Where two
    rows have one of these in common, the pair comes up there already, so they do not meet:
    the first n-gram that a pair shares has none, and there a pair that links passes.

    Rows of an n-gram meet by length band: bands are as wide as the length filter reaches,
    so a set's partners of its own size or more lie in its band or the next. The m rows of
    an n-gram and band lie on a grid of cells of PAIRED_ROWS by PAIRED_ROWS; each row is
    copied to its line or column, ``m / PAIRED_ROWS`` times, and up to PAIRED_ROWS rows
    not at all.
    """
    band = F.floor(F.log("n") / (max(math.log(100 / percent), 0.01) * 1.0001)).cast("int")
    before = Window.partitionBy("node").orderBy("pos").rowsBetween(-BEFORE, -1)
    right = open_rows.withColumns({"band": band, "before": F.collect_list("h").over(before)})
    # The smaller set of a pair needs only its index prefix, 1 - 2t/(1+t) of the set.
    indexed = F.col("pos") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent))
    reach = lambda df: df.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    left = reach(right.filter(indexed))
    # Written first, so that Spark knows its size and sends it to the tasks where it is small.
    many = reach(right.select("h", "band")).groupBy("h", "band").agg(F.ceil(F.count(F.lit(1)) / PAIRED_ROWS).cast("int").alias("cells")).filter("cells > 1")
    many = stored(many, "jaccard-many")
    side = lambda df, x: df.select("h", "band", *[F.col(c).alias(f"{x}{c}") for c in ("node", "n", "pos", "root", "before", *SIGNS)])

    def on_grid(rows: DataFrame, own: str, other: str, node: str) -> DataFrame:
        rows = rows.join(many, ["h", "band"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        rows = rows.withColumn(own, F.pmod(F.xxhash64(node), F.col("cells")).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")

    left, right = on_grid(side(left, "l"), "line", "column", "lnode"), on_grid(side(right, "r"), "column", "line", "rnode")
    first = F.struct("ln", "lnode") < F.struct(F.col("rn").alias("ln"), F.col("rnode").alias("lnode"))
    met = left.join(right, ["h", "band", "line", "column"]).filter((F.col("lroot") != F.col("rroot")) & first & _may_link("l", "r", percent) & _suffix("l", "r", percent) & ~F.arrays_overlap("lbefore", "rbefore"))
    return met.select(F.col("lnode").alias("a"), F.col("rnode").alias("b"), _far("l", "r"))


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, far) whose nodes lie in different components x and y."""
    root = lambda x, at: labels.select(F.col("node").alias(x), F.col("root").alias(at))
    named = pairs.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left")
    ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return named.filter(ra != rb).select("a", "b", "far", F.least(ra, rb).alias("x"), F.greatest(ra, rb).alias("y"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    return components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _salted(many: DataFrame, few: DataFrame, key: str, deal: list[str]) -> DataFrame:
    """``many`` left join ``few`` on ``key``, where many rows may share one key."""
    many = many.withColumn("salt", F.pmod(F.xxhash64(*deal), F.lit(SALTS)))
    return many.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"], "left").drop("salt")


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    Links: 100 * |intersection| >= percent * |union| of distinct word n-grams; with
    fewer words the whole sequence is the one n-gram; without words or with null text
    the set is empty and links nothing. Rows that repeat an id count as one node if
    their sets are equal; each gives a row. Rows with a null id link nothing and get
    a null component. N-grams are compared by 64-bit hashes and whole sets known by 128
    bits. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    survey = stored(_survey(docs, n), "jaccard-survey")
    meta = survey.filter("kind = 0").drop("kind", "counts")
    told = meta.filter("n > 0 and doc_id is not null")
    clashes = frozenset(r["node"] for r in told.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x != y").select("node").limit(CLASHES + 1).collect())
    if len(clashes) > CLASHES:
        raise RuntimeError(f"over {CLASHES} sets share their hash with another set")
    if clashes:
        meta, told = (x.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("check")).otherwise(F.col("node"))) for x in (meta, told))
    nodes = told.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), *[F.first(g).alias(g) for g in SIGNS])

    by_gram = Window.partitionBy("h", "salt")
    grams = _prefixes(docs, n, percent, _bucket_counts(survey), clashes).withColumns({"lead": F.min(F.struct("node", "n", "pos")).over(by_gram), "most": F.max("node").over(by_gram)})
    grams = grams.filter((F.col("lead.node") != F.col("most")) | (F.col("salt") >= 0))
    grams_at = shared_path(docs.sparkSession, "jaccard-grams")
    grams = stored(grams.select("h", "salt", "node", "n", "pos", F.col("lead.node").alias("lnode"), F.col("lead.n").alias("ln"), F.col("lead.pos").alias("lpos")).distinct(), "", grams_at)

    leads = grams.filter("salt >= 0").select("h", F.struct(F.col("lnode").alias("node"), F.col("ln").alias("n"), F.col("lpos").alias("pos")).alias("x")).distinct()
    tops = leads.join(leads.groupBy("h").agg(F.min("x").alias("l")), "h").select("x.*", F.col("l.node").alias("lnode"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"))
    stars = grams.select("node", "n", "pos", "lnode", "ln", "lpos").unionByName(tops).filter("node != lnode").filter(_may_link("", "l", percent))
    tried = _pairs(_likeliest(stars.select(F.col("node").alias("a"), F.col("lnode").alias("b"))))
    tried = stored(_suffix_filtered(tried, nodes, percent), "jaccard-pairs")
    links = stored(_checked(docs, nodes, tried, n, percent, clashes), "jaccard-links", batch_rows=SET_ROWS)
    labels = components(links)

    # ``grams`` holds a node once an n-gram: its salt and leader follow from these.
    open_rows = _open(grams.select("h", "node", "n", "pos"), labels).join(nodes.select("node", *SIGNS), "node")
    at = shared_path(docs.sparkSession, "jaccard-open")
    open_rows = stored(open_rows, "", at)
    remove(grams_at)
    for turn in range(STAR_TURNS):
        fresh = _stars(open_rows, turn, percent).select("a", "b", "far", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        fresh = fresh.join(tried.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti").select("a", "b", "far")
        pairs = stored(_pairs(_nearest(fresh)), "jaccard-pairs")
        links = stored(_checked(docs, nodes, pairs, n, percent, clashes), "jaccard-links", batch_rows=SET_ROWS)
        found, tried = links.count(), tried.union(pairs)
        if found:
            # Components only grow, so what is open now was open before.
            labels = _merged(labels, links)
            before, at = at, shared_path(docs.sparkSession, "jaccard-open")
            open_rows = stored(_open(open_rows.drop("root"), labels), "", at)
            remove(before)
        if found <= WORTH * pairs.count():
            break

    last = _across(open_rows, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "far").distinct()
    last = stored(_between(last.join(tried, ["a", "b"], "left_anti"), labels), "jaccard-last")
    for _ in range(NEAREST_TURNS):
        if last.count() <= FEW_PAIRS:
            break
        pairs = stored(last.groupBy("x", "y").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b"), "jaccard-pairs")
        links = stored(_checked(docs, nodes, pairs, n, percent, clashes), "jaccard-links", batch_rows=SET_ROWS)
        if links.isEmpty():
            break
        labels = _merged(labels, links)
        last = stored(_between(last.drop("x", "y").join(pairs, ["a", "b"], "left_anti"), labels), "jaccard-last")
    if not last.isEmpty():
        labels = _merged(labels, stored(_checked(docs, nodes, last.select("a", "b"), n, percent, clashes), "jaccard-links", batch_rows=SET_ROWS))

    # Only nodes with links or with copies have another id than their own to take.
    joined = labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "doc_id"), "node")
    lows = _salted(joined, joined.groupBy("root").agg(F.min("doc_id").alias("low")), "root", ["node"]).select("node", "low")
    copied = nodes.filter("copies > 1").join(lows, "node", "left_anti").select("node", F.col("doc_id").alias("low"))
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).otherwise(F.col("doc_id"))
    return _salted(meta, lows.unionByName(copied), "node", ["doc_id"]).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the smallest id of each group of similar documents; documents
    without words all stay, and so do rows with a null id."""
    groups = similar_groups(docs, n, percent).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
