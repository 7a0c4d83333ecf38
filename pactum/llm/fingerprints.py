"""Document fingerprints from prefix polynomial hashes.

A text of code points c has prefix arrays S[i] = sum of c[j] * B^j modulo a prime, for
two primes. (S[j] - S[i]) * B^-i is the hash of the span [i, j), so equality of any
two spans is a comparison of two numbers, and the longest common extension of two
places is a binary search over span lengths. A fingerprint keeps the SKETCH
smallest distinct hashes of all spans of WIDTH code points; the likeness of two
fingerprints estimates the Jaccard similarity of their texts' span sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
BASE = 1000003
WIDTH, SKETCH = 16, 64
#: Bytes of texts in a range of ids that one task takes, about.
PART_BYTES = 128 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of BASE and of its inverse modulo each prime, as far as texts needed so far."""

    def __init__(self):
        self.n, self.up, self.down = 0, (), ()

    def reach(self, n: int) -> None:
        if n <= self.n:
            return
        self.n = max(1024, 2 * n)
        self.up = tuple(self._row(BASE, int(p)) for p in PRIMES)
        self.down = tuple(self._row(pow(BASE, -1, int(p)), int(p)) for p in PRIMES)

    def _row(self, base: int, p: int) -> np.ndarray:
        out = np.ones(self.n + 1, np.uint64)
        done = 1
        while done <= self.n:
            step = min(done, self.n + 1 - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, p)) % np.uint64(p)
            done += step
        return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Prefixes:
    """Prefix arrays of one text; spans of it are compared in constant time."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        powers.reach(len(codes))
        self.n, self.powers = len(codes), powers
        self.sums = []
        for p, up in zip(PRIMES, powers.up, strict=True):
            # Terms stay under 2^31, so sums of 2^32 of them fit.
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * up[: self.n] % p, out=s[1:])
            self.sums.append(s % p)

    def span(self, i: int, j: int) -> tuple[int, int]:
        return tuple(int((s[j] + p - s[i]) % p * down[i] % p) for s, p, down in zip(self.sums, PRIMES, self.powers.down, strict=True))

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width``, both primes joined to 62 bits."""
        m = self.n - width + 1
        a, b = ((s[width:] + p - s[:m]) % p * down[:m] % p for s, p, down in zip(self.sums, PRIMES, self.powers.down, strict=True))
        return a << np.uint64(31) | b


def common_extension(x: Prefixes, i: int, y: Prefixes, j: int) -> int:
    """Length of the longest common prefix of x[i:] and y[j:]."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if x.span(i, i + mid) == y.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def sketch(x: Prefixes, width: int = WIDTH, size: int = SKETCH) -> np.ndarray:
    """The smallest distinct mixed span hashes, 32 bits each; a text shorter than
    ``width`` is one span, the empty text has none."""
    if not x.n:
        return np.empty(0, np.uint32)
    h = (x.spans(min(width, x.n)) * _MIX >> np.uint64(32)).astype(np.uint32)
    take = 4 * size
    while take < len(h):
        found = np.unique(np.partition(h, take)[:take])
        if len(found) >= size:
            return found[:size]
        take *= 4
    return np.unique(h)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of the smallest hashes of the union that both have; two empty texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, a).__and__(np.isin(union, b)).mean())


def _hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, doc_id, text, borrowed): documents dealt by ranges of descending doc_id. Each
    part also holds, marked ``borrowed``, the first document of the part that follows
    (after the last part: of the first), so that a task sees every next document.

    The driver holds the range bounds and first ids, ``parts`` numbers each.
    """
    ids = docs.filter("doc_id is not null").select("doc_id")
    found = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in found}, reverse=True)
    # Part k: bounds[k - 1] > id >= bounds[k]; ids in descending order, null last.
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.asarray([-b for b in bounds], np.int64))

    def deal(batches, firsts=None):
        negative = shared.value
        takes = firsts.value if firsts is not None else {}
        for batch in batches:
            ids = batch.column(0)
            part = np.searchsorted(negative, -ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), side="left").astype(np.int32)
            part[np.asarray(ids.is_null())] = len(negative)
            lent = [(i, q) for i, v in enumerate(ids.to_pylist()) if v in takes for q in takes[v]]
            table = pa.Table.from_batches([batch]).append_column("part", pa.array(part)).append_column("borrowed", pa.array([False] * len(part)))
            if lent:
                more = pa.Table.from_batches([batch]).take([i for i, _ in lent])
                table = pa.concat_tables([table, more.append_column("part", pa.array([q for _, q in lent], pa.int32())).append_column("borrowed", pa.array([True] * len(lent)))])
            yield from table.combine_chunks().to_batches()

    dealt = docs.select("doc_id").mapInArrow(deal, "doc_id long, part int, borrowed boolean").groupBy("part").agg(F.max("doc_id").alias("first"))
    heads = sorted(tuple(r) for r in dealt.collect())
    takes: dict = {}
    for k, (part, _) in enumerate(heads):
        takes.setdefault(heads[(k + 1) % len(heads)][1], []).append(part)
    lend = spark.sparkContext.broadcast(takes)
    rows = docs.select("doc_id", "text").mapInArrow(lambda b: deal(b, lend), "doc_id long, text string, part int, borrowed boolean")
    return rows.repartition(max(1, len(heads)), "part").sortWithinPartitions("part", "borrowed", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, common_prefix (longest common extension of text and edited text at 0).

    Null text is empty. The next document is the one before in order of doc_id (null
    ids come last, rows that repeat an id go by text); the last one's is the first;
    a lone document is its own next. Rows lent to another part repeat no result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not parts:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def result(powers, a, b):
        (doc_id, text, own, print_), (_, next_text, _, next_print) = a, b
        cut = len(text) // 2
        edited = text[: len(text) - cut] + next_text[:cut]
        whole = Prefixes(points(edited), powers)
        edited_print = sketch(whole)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(print_), _hex(edited_print), likeness(print_, edited_print), likeness(print_, next_print), common_extension(own, 0, whole, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, before, part, rows = Powers(), None, None, []
        for batch in batches:
            for doc_id, text, p, borrowed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Prefixes(points(text), powers)
                here = (doc_id, text, own, sketch(own))
                if before is not None and part == p:
                    rows.append(result(powers, before, here))
                before, part = (None if borrowed else here), p
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return with_next(docs, parts).select("doc_id", "text", "part", "borrowed").mapInArrow(run, schema)
