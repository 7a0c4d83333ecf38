"""SentencePiece encoding and decoding over a relational lattice.

A text is cut wherever no piece of the vocabulary can cross (``spans.Cutter``). For
each distinct chunk of the corpus:

* its substrings up to the longest piece are exploded and equi-joined to the piece
  table (a fixed vocabulary, broadcast, joined by hash and compared in full); what joins
  is an edge of the lattice, and a character that is no piece gives an edge of its
  UTF-8 byte pieces;
* edges are grouped by chunk, and Viterbi is a fold over them from the end of the chunk
  backwards, of many chunks at a time: the best edge from each place to the end. A chunk
  of over LONG_CHUNK characters takes the same fold in a Python loop, linear in its
  length, because places of one chunk cannot be taken together.

Texts then look up their chunks: the commonest (at most DICTIONARY chunks of together at
most DICTIONARY_BYTES) lie in a file that one task writes to the shared folder and each
worker reads, the rest come by a shuffle join per text.
"""

from __future__ import annotations

import hashlib
import io
import pickle
from collections import Counter
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEEPERS, give_back, let_go, remove, shared_path, stored
from .lattice import MARK, vocabulary
from .spans import Cutter, Dictionary, gather, narrow

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DICTIONARY, DICTIONARY_BYTES, CHUNK_BYTES = 1 << 19, 1 << 24, 1 << 12
#: Characters above which the fold over a chunk is a loop; the path is the same.
LONG_CHUNK = 512
#: Distinct chunks that a counting task holds.
HOLD = 100_000
#: Characters of chunks whose edges a task groups.
LATTICE_CHARS = 250_000
#: Bytes of a row in which the dictionary of common chunks is written.
PART = 1 << 22
#: That dictionary, as a Python worker holds it.
_HELD: dict[str, tuple] = {}
KEEPERS.append(_HELD.clear)
#: How an edge is one number: bits of a place and of an id, and what makes ids of characters positive.
PLACE_BITS, ID_BITS, LEAST_ID = 16, 24, 0x110000
#: Score of a character that is no piece: there is no other edge over it.
UNKNOWN_SCORE = -1e5


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(piece, id, score), the longest piece, and the id of byte piece 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(p.replace(MARK, " "), i, float(s)) for i, p, s in vocabulary(path)]
    first = model.piece_to_id("<0x00>")
    if any(model.piece_to_id(f"<0x{b:02X}>") != first + b for b in range(256)):
        raise ValueError("the vocabulary has no run of byte pieces")
    piece, id_, score = zip(*rows, strict=True)
    table = pa.table({"piece": pa.array(piece), "id": pa.array(id_, pa.int32()), "score": pa.array(score)})
    return spark.createDataFrame(table), max(map(len, piece)), first


def cutter(path: str = VOCABULARY) -> Cutter:
    return Cutter([p.replace(MARK, " ") for _, p, _ in vocabulary(path)])


def count_chunks(docs: DataFrame, text: str, path: str = VOCABULARY) -> DataFrame:
    """(chunk, n): the distinct chunks of all texts with their uses. A task holds at most
    HOLD chunks; what it passes on is summed again."""
    shared = docs.sparkSession.sparkContext.broadcast(cutter(path))

    def run(batches):
        let_go()
        known, held, uses, new = Dictionary([]), [], np.empty(0, np.int64), Counter()

        def out(chunks, n):
            for at in range(0, len(chunks), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(chunks[at : at + 20_000], pa.string()), pa.array(n[at : at + 20_000], pa.int64())], ["chunk", "n"])

        for batch in batches:
            for _, _, passes in shared.value.passes(batch.column(0)):
                for some in passes:
                    found = known.find(some)
                    uses += np.bincount(found[found >= 0], minlength=len(uses))
                    for chunk, n in zip(*some.counted(np.flatnonzero(found < 0)), strict=True):
                        new[chunk] += int(n)
                    if len(held) + len(new) > HOLD:
                        yield from out(held, uses)
                        held, uses = [], np.empty(0, np.int64)
                    if 2 * len(new) > len(held):
                        held, uses = held + list(new), np.append(uses, np.fromiter(new.values(), np.int64, len(new)))
                        known, new = Dictionary(held), Counter()
        yield from out(held + list(new), np.append(uses, np.fromiter(new.values(), np.int64, len(new))))

    return docs.select(text).mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def _expand(ids: pa.ListArray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, lengths) of lists of ids; a negative id stands for a character and
    becomes its byte pieces."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = np.flatnonzero(flat < 0)
    if not len(bad):
        return flat, lengths
    own = [first + np.frombuffer(chr(-i - 1).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32) for i in flat[bad].tolist()]
    width = np.ones(len(flat), np.int64)
    width[bad] = [len(x) for x in own]
    out = np.repeat(flat, width)
    out[np.repeat(flat < 0, width)] = np.concatenate(own)
    wide = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum(lengths)
    return out, wide[ends] - wide[ends - lengths]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task unpacks few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def best_path(chunk: str, pieces: dict[str, tuple[int, float]], longest: int) -> tuple[float, list[int]]:
    """Score and ids of the best path through one chunk's lattice, as ``best_paths`` has them."""
    score, step = [0.0] * (len(chunk) + 1), [(0, 0)] * len(chunk)
    for s in range(len(chunk) - 1, -1, -1):
        best = None
        for e in range(min(len(chunk), s + longest), s, -1):
            found = pieces.get(chunk[s:e])
            if found is None:
                if e > s + 1:
                    continue
                found = (-ord(chunk[s]) - 1, UNKNOWN_SCORE)
            total = score[e] + found[1]
            if best is None or total > best:
                best, step[s] = total, (e, found[0])
        score[s] = best
    ids, at = [], 0
    while at < len(chunk):
        at, i = step[at]
        ids.append(i)
    return score[0], ids


def _long_paths(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``best_paths`` of the long chunks, by a loop over each."""
    shared = words.sparkSession.sparkContext.broadcast({r["piece"]: (r["id"], r["score"]) for r in pieces.collect()})

    def run(batches):
        for batch in batches:
            for chunk, n in zip(batch.column(0), batch.column(1), strict=True):
                score, ids = best_path(chunk.as_py(), shared.value, longest)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.string()), pa.array([n.as_py()], pa.int64()), pa.array([score]), pa.array([ids], pa.list_(pa.int32()))], ["chunk", "n", "score", "ids"])

    return words.select("chunk", "n").mapInArrow(run, "chunk string, n long, score double, ids array<int>")


def best_paths(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(chunk, n) -> (chunk, n, score, ids): the best-scoring path through each lattice. Of equal
    scores the path whose first piece is longest wins, then the one after, and so on.
    A negative id, -c - 1, stands for a character c that is no piece.

    Chunks are dealt by their characters, so that a task groups few edges; the grouping
    needs no further shuffle.
    """
    pieces, longest, _ = piece_table(words.sparkSession, path)
    long = _long_paths(words.filter(F.length("chunk") > LONG_CHUNK), pieces, longest)
    words = words.filter(F.length("chunk") <= LONG_CHUNK)
    size = F.length("chunk")
    words = words.repartition(max(1, -(-(words.agg(F.sum(size)).first()[0] or 0) // LATTICE_CHARS)), "chunk")
    # A number by which rows lie in order already, so that grouping has little to sort.
    words = words.withColumn("at", F.monotonically_increasing_id())
    own = ["at", "chunk", "n"]
    starts = F.explode(F.sequence(F.lit(0), size - 1)).alias("s")
    spans = words.select(*own, starts).select(*own, "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("s")))).alias("k"))
    spans = spans.withColumn("span", F.substring(F.col("chunk"), F.col("s") + 1, F.col("k"))).withColumn("h", F.xxhash64("span"))
    # The join is on the hash alone, a number; what meets is then compared in full.
    met = spans.join(F.broadcast(pieces.select("piece", "id", F.xxhash64("piece").alias("h"))), "h", "left")
    same = F.coalesce(F.col("piece") == F.col("span"), F.lit(False))
    edges = met.filter(same | (F.col("k") == 1))
    # Places are counted from the end of the chunk: an edge leads from ``p`` to ``q`` < ``p``.
    p, id_ = (size - F.col("s")).cast("long"), F.when(same, F.col("id")).otherwise(-F.ascii("span") - 1)
    edge = (p * (1 << PLACE_BITS) + p - F.col("k")) * (1 << ID_BITS) + id_ + LEAST_ID
    lattice = edges.groupBy(*own).agg(F.collect_list(edge).alias("edges"))

    worth = np.zeros(1 + max(i for i, _, _ in vocabulary(path)))
    for i, _, score in vocabulary(path):
        worth[i] = score
    shared = words.sparkSession.sparkContext.broadcast(worth)

    def run(batches):
        for batch in batches:
            score, ids = fold_edges(batch.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), ids], ["chunk", "n", "score", "ids"])

    return lattice.select("chunk", "n", "edges").mapInArrow(run, "chunk string, n long, score double, ids array<int>").unionByName(long)


def fold_edges(lattices: pa.ListArray, worth: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Score and ids of the best path through each of many lattices. An edge is one number:
    place, place it leads to, and id, from the high bits down; ``worth`` has the score of each id.

    All lattices take a step together, from the end of the chunks backwards: the best edge of
    each place is chosen once those of all later places are."""
    flat, counts = lattices.flatten().to_numpy(), pc.list_value_length(lattices).to_numpy(zero_copy_only=False)
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    p = flat >> (PLACE_BITS + ID_BITS)
    # By place, lattice and length, the longest first: of equal scores the first one stays.
    order = np.lexsort((flat, row, p))
    flat, row, p = flat[order], row[order], p[order]
    q, ids = (flat >> ID_BITS) & ((1 << PLACE_BITS) - 1), (flat & ((1 << ID_BITS) - 1)) - LEAST_ID
    size = np.zeros(n, np.int64)
    np.maximum.at(size, row, p)
    base = np.cumsum(size + 1) - size - 1
    at, to = base[row] + p, base[row] + q
    gain = np.where(ids < 0, UNKNOWN_SCORE, worth[np.maximum(ids, 0)])
    first = np.flatnonzero(np.diff(at, prepend=-1))
    width = np.diff(np.append(first, len(at)))
    score, taken = np.zeros(n + int(size.sum())), np.zeros(n + int(size.sum()), np.int64)
    levels = [*np.flatnonzero(np.diff(p[first], prepend=-1)).tolist(), len(first)]
    for a, b in zip(levels, levels[1:], strict=False):
        low, high = first[a], first[b - 1] + width[b - 1]
        total = score[to[low:high]] + gain[low:high]
        best = np.maximum.reduceat(total, first[a:b] - low)
        hits = np.flatnonzero(total == np.repeat(best, width[a:b]))
        node = at[low:high][hits]
        once = np.diff(node, prepend=-1) != 0
        score[node[once]], taken[node[once]] = best, low + hits[once]
    left, place, rows, path = np.flatnonzero(size), size.copy(), [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    while len(left):
        edge = taken[base[left] + place[left]]
        rows.append(left)
        path.append(ids[edge].astype(np.int32))
        place[left] = q[edge]
        left = left[place[left] > 0]
    rows, path = np.concatenate(rows), np.concatenate(path)
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return score[base + size], pa.ListArray.from_arrays(pa.array(ends), pa.array(path[np.argsort(rows, kind="stable")]))


def _common(lexicon: DataFrame, first: int) -> str:
    """The commonest chunks, by steps of frequency as far as the bounds reach, with their
    flat ids, where those start, how many they are, and scores: built by one task and
    written to the shared folder for ``_dictionary``, so the driver holds none of it."""
    short = lexicon.filter(F.octet_length("chunk") <= CHUNK_BYTES).withColumn("step", F.floor(F.log2("n") * 8))
    held, size, least = 0, 0, None
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("chunk")).alias("size")).collect(), reverse=True):
        held, size = held + r["n"], size + r["size"]
        if held > DICTIONARY or size > DICTIONARY_BYTES:
            break
        least = r["step"]
    rows = short.filter(F.lit(False) if least is None else F.col("step") >= least).select("chunk", "score", "ids")

    def build(batches):
        let_go()
        table = pa.Table.from_batches(list(batches), pa.schema([("chunk", pa.string()), ("score", pa.float64()), ("ids", pa.list_(pa.int32()))])).combine_chunks()
        blob = pickle.dumps(_flat_dictionary(table, first), 5)
        for at in range(0, len(blob), PART):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([blob[at : at + PART]], pa.binary())], ["at", "part"])

    place = shared_path(lexicon.sparkSession, "pieces-dictionary")
    stored(rows.repartition(1).mapInArrow(build, "at long, part binary"), "", place)
    return place


def _flat_dictionary(table: pa.Table, first: int) -> tuple[Dictionary, tuple]:
    ids = table.column("ids")
    flat, lengths = _expand(ids.chunk(0) if ids.num_chunks else pa.array([], pa.list_(pa.int32())), first)
    return Dictionary(table.column("chunk").to_pylist()), (narrow(flat), narrow(np.cumsum(lengths) - lengths), narrow(lengths), table.column("score").to_numpy())


class _Parts(io.RawIOBase):
    """The parts of a stored dictionary as one stream."""

    def __init__(self, table):
        self.parts = (memoryview(x.as_buffer()).cast("B") for batch in table.iter_batches(1, columns=["part"]) for x in batch.column(0))
        self.left = memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not len(self.left):
            self.left = next(self.parts, None)
            if self.left is None:
                self.left = memoryview(b"")
                return 0
        n = min(len(target), len(self.left))
        target[:n], self.left = self.left[:n], self.left[n:]
        return n


def _dictionary(place: str, first: int) -> tuple[Dictionary, tuple]:
    """What ``_common`` wrote, read once a Python worker, which keeps the last one."""
    if place not in _HELD:
        from pyarrow import fs, parquet

        _HELD.clear()
        files, path = fs.FileSystem.from_uri(place)
        found = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet")]
        none = pa.table({"chunk": pa.array([], pa.string()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int32()))})
        # One task wrote the parts, so they stand in one file, in order; they are read one by one.
        with ExitStack() as opened:
            tables = [parquet.ParquetFile(opened.enter_context(files.open_input_file(f))) for f in found]
            filled = [t for t in tables if t.metadata.num_rows]
            if len(filled) > 1:
                raise ValueError(f"{place} holds more than one dictionary")
            _HELD[place] = pickle.load(io.BufferedReader(_Parts(filled[0]))) if filled else _flat_dictionary(none, first)
    return _HELD[place]


def _encoded(docs: DataFrame, path: str, then=None, schema: str | None = None) -> DataFrame:
    """``docs`` (any columns and ``text``, named apart from key, more, ids and score) with ids
    and score instead of the text; ``then`` turns a batch of these and the texts into one of ``schema``."""
    spark = docs.sparkSession
    counted, known = shared_path(spark, "pieces-chunks"), shared_path(spark, "pieces-lexicon")
    words = stored(count_chunks(docs, "text", path), "", counted)
    lexicon = stored(best_paths(words, path), "", known)
    remove(counted)
    first = piece_table(spark, path)[2]
    shared, place = spark.sparkContext.broadcast(cutter(path)), _common(lexicon, first)
    # Documents that share a key share what they are given, which harms none.
    keyed = docs.withColumn("key", F.xxhash64(*docs.columns))

    def missing(batches):
        give_back()
        cut, (known, _) = shared.value, _dictionary(place, first)
        for batch in batches:
            for low, _, passes in cut.passes(batch.column(0)):
                for some in passes:
                    rest = np.flatnonzero(known.find(some) < 0)
                    rows = low + np.repeat(np.arange(len(some.counts)), some.counts)[rest]
                    found = sorted(set(zip(rows.tolist(), some.chunks(rest), strict=True)))
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array([i for i, _ in found], pa.int64())), pa.array([c for _, c in found], pa.string())], ["key", "chunk"])

    given = F.struct("chunk", "score", "ids")
    rest = keyed.select("text", "key").mapInArrow(missing, "key long, chunk string").join(lexicon, "chunk").groupBy("key").agg(F.collect_set(given).alias("more"))
    rest = stored(rest, "pieces-more")
    remove(known)
    at, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def pack(batches):
        squeeze = zstandard.ZstdCompressor()
        for batch in slices(batches):
            packed = [None if t is None else squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(packed, pa.binary()))

    # Texts travel compressed: they are most of what this join moves.
    types = ", ".join(f"`{n}` {'binary' if n == 'text' else t}" for n, t in keyed.dtypes)
    joined = keyed.mapInArrow(pack, types).join(rest, "key", "left").select(*docs.columns, "more")
    width = len(docs.columns)

    def run(batches):
        give_back()
        cut, (known, (flat, starts, lengths, scores)) = shared.value, _dictionary(place, first)
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            more = batch.column(width)
            texts = pa.array([None if t is None else unpack.decompress(t) for t in batch.column(at).to_pylist()], pa.binary()).cast(pa.string())
            for low, high, passes in cut.passes(texts):
                # What this slice was given stands beside the dictionary, by row and chunk: a copy of both
                # together would be larger than the slice.
                own = more.slice(low, high - low)
                given = own.flatten()
                row = np.repeat(np.arange(high - low), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
                own_flat, own_lengths = _expand(given.field("ids"), first)
                spot = {k: i for i, k in enumerate(zip(row.tolist(), given.field("chunk").to_pylist(), strict=True))}
                own_starts, own_scores = np.cumsum(own_lengths) - own_lengths, given.field("score").to_numpy(zero_copy_only=False)
                ids, n, score = [], np.zeros(high - low, np.int64), np.zeros(high - low)
                for some in passes:
                    found = known.find(some)
                    hit, rest = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
                    text = np.repeat(np.arange(high - low if len(some.counts) > 1 else 1), some.counts)
                    mine = np.fromiter((spot[k] for k in zip(text[rest].tolist(), some.chunks(rest), strict=True)), np.int64, len(rest))
                    size, worth, at_hand = np.empty(len(found), np.int64), np.empty(len(found)), found[hit]
                    size[hit], size[rest] = lengths[at_hand], own_lengths[mine]
                    worth[hit], worth[rest] = scores[at_hand], own_scores[mine]
                    of = np.repeat(found >= 0, size)
                    both = np.empty(len(of), np.int32)
                    both[of] = gather(flat, starts[at_hand].astype(np.int64), size[hit])
                    both[~of] = gather(own_flat, own_starts[mine], size[rest])
                    ids.append(both)
                    n += np.bincount(text, size, high - low).astype(np.int64)
                    score += np.bincount(text, worth, high - low)
                slim = batch.slice(low, high - low).select(kept)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids)))
                out = pa.RecordBatch.from_arrays([*slim.columns, lists, pa.array(score)], [*kept, "ids", "score"])
                yield then(out, texts.slice(low, high - low)) if then else out

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return joined.mapInArrow(run, schema or f"{fields}, ids array<int>, score double")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, text, ids array<int>, score (sum over the best paths).

    Null and empty texts have no pieces and score 0. Each row gives a row, repeated
    ids and repeated rows too. Other columns are dropped.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(text_col).alias("own"))
    return _encoded(slim, path).select("doc_id", F.col("own").alias("text"), "ids", "score")


def _piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id; control pieces have none."""
    import sentencepiece

    first = sentencepiece.SentencePieceProcessor(model_file=path).piece_to_id("<0x00>")
    texts = {i: p.replace(MARK, " ").encode() for i, p, _ in vocabulary(path)} | {first + b: bytes([b]) for b in range(256)}
    return [texts.get(i, b"") for i in range(max(texts) + 1)]


def _joined(lists: pa.ListArray, table: pa.Array) -> list[bytes | None]:
    """The bytes of each list of ids, without the space in front; None for a null list."""
    parts = table.take(lists.flatten())
    bounds = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
    data = memoryview(parts.buffers()[2] or b"")
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    ends = bounds[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    return [bytes(data[a + 1 : b]) if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]


def decode(encoded: DataFrame, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its pieces; bytes that are no UTF-8 become
    U+FFFD, and ids of control pieces have no text. Null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(_piece_bytes(path))
    at = encoded.columns.index(ids)

    def run(batches):
        table = pa.array(shared.value, pa.binary())
        for batch in batches:
            out = [x if x is None else x.decode("utf-8", "replace") for x in _joined(batch.column(at), table)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_pieces, score, ids_sha256 (of the ids as little-endian 32-bit
    numbers), decoded_sha256 (of the bytes that the ids stand for), same (these bytes are
    those of the whole text, by length and digest; null counts as empty). A task decodes
    what it has encoded from the ids alone."""
    shared = docs.sparkSession.sparkContext.broadcast(_piece_bytes(VOCABULARY))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def check(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        lists = batch.column("ids")
        back = _joined(lists, pa.array(shared.value, pa.binary()))
        whole = texts.cast(pa.binary()).fill_null(b"").to_pylist()
        n = pc.list_value_length(lists).cast(pa.int64())
        flat, ends = lists.flatten().to_numpy(), np.cumsum(n.to_numpy()).tolist()
        out = [
            batch.column("doc_id"), pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64()), n, batch.column("score"), pa.array([sha(flat[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False)], pa.string()),
            pa.array(map(sha, back), pa.string()), pa.array([len(x) == len(t) and sha(x) == sha(t) for x, t in zip(back, whole, strict=True)], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_chars", "n_pieces", "score", "ids_sha256", "decoded_sha256", "same"])

    rows = _encoded(docs.select("doc_id", "text"), VOCABULARY, check, "doc_id long, n_chars long, n_pieces long, score double, ids_sha256 string, decoded_sha256 string, same boolean")
    # Written here, in small batches: a caller's batches could hold all texts of a partition at once.
    return stored(rows, "pieces-rows")
