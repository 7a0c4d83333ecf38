"""Packing documents into token sequences of one length, neighbours in content side by side.

Each document is encoded once; the counts of its ids, hashed to a vector of unit length,
are projected to a few dimensions. Places along a Hilbert curve through these dimensions
sort the documents by range, and the stream of their tokens in that order is cut every
``length`` tokens. Positions come from a sort of narrow rows (place, row, tokens); the
tokens themselves are shuffled once, to meet their position.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache
from math import sqrt

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
END, LENGTH = 1, 2048
#: Buckets of a hashed document vector, dimensions it is projected to, bits of a coordinate.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 15
#: Texts of at most so many characters are encoded at a time.
ENCODE_CHARS = 1 << 20
FLUSH_TOKENS = 1 << 20


class Encoder:
    """Ids of texts by a ``tokenizers`` file. ``ranks``, the same vocabulary as a table of merge
    ranks, gives the same ids (tests hold every code point, long runs and special tokens)
    in a fifth of the time; without it the file's own library encodes."""

    def __init__(self, path: str, ranks: str | None = None):
        self.own = Tokenizer.from_file(path)
        self.size = self.own.get_vocab_size(with_added_tokens=True)
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.own.get_added_tokens_decoder().items()}
            self.quick = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def __call__(self, texts: list[str]) -> list:
        if self.quick:
            return [self.quick.encode(t, allowed_special="all") for t in texts]
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One a worker."""
    return Encoder(path, ranks)


@cache
def directions(size: int, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each id and the projection of each bucket; fixed by the sizes alone."""
    ids = np.arange(size, dtype=np.uint64)
    return (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets, np.random.default_rng(12).standard_normal((buckets, dimensions))


def project(ids: np.ndarray, size: int) -> np.ndarray:
    """Damped counts of the ids by bucket, scaled to unit length and projected."""
    bucket, to = directions(size)
    vector = np.sqrt(np.bincount(bucket[ids], minlength=len(to)))
    norm = sqrt(float(vector @ vector))
    return vector @ to / norm if norm else np.zeros(to.shape[1])


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of non-negative integers under 2^bits.

    From the highest bit down, each step undoes the turn of the sub-cube (reflect or swap
    with the first axis); what is left, Gray-decoded and interleaved, is the place.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            inside = (x[:, i] & q) > 0
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inside, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> bit) & 1 > 0, (1 << bit) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | x[:, i] >> bit & 1
    return place


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, end: int = END) -> DataFrame:
    """(doc_id, row, tokens, ids, v1..vk): ids of the whole text and ``end``, as little-endian
    integers of 16 or 32 bits; ``row`` numbers the rows; v are the projected vector."""
    names = [f"v{k + 1}" for k in range(DIMENSIONS)]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        kind = id_type(encode.size, end)
        for batch in batches:
            for doc_ids, texts in _portions(batch):
                found = [np.fromiter((*ids, end), np.int64, len(ids) + 1) for ids in encode(texts)]
                places = np.asarray([project(ids[:-1], encode.size) for ids in found]).reshape(len(found), DIMENSIONS)
                columns = [doc_ids, pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype(kind).tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, places.T.copy())], ["doc_id", "tokens", "ids", *names])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ", ".join(["doc_id long, tokens long, ids binary", *(f"{v} double" for v in names)]))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "packing-ids")


def id_type(size: int, end: int) -> np.dtype:
    return np.dtype("<u2" if max(size, end + 1) <= 1 << 16 else "<u4")


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows of a batch, some characters at a time."""
    start, chars, texts = 0, 0, []
    for at, text in enumerate(batch.column(1)):
        texts.append(text.as_py())
        chars += len(texts[-1])
        if chars >= ENCODE_CHARS:
            yield batch.column(0).slice(start, at + 1 - start), texts
            start, chars, texts = at + 1, 0, []
    if texts:
        yield batch.column(0).slice(start), texts


def _places(rows: DataFrame) -> DataFrame:
    """(row, tokens, place): the Hilbert place of the projected vector. Each dimension is laid
    on its even grid by the normal distribution of its mean and spread over all documents."""
    names = [f"v{k + 1}" for k in range(DIMENSIONS)]
    found = rows.agg(*[f(v).alias(f"{v}_{f.__name__}") for v in names for f in (F.avg, F.stddev_pop)]).first()
    mean = np.asarray([found[f"{v}_avg"] or 0.0 for v in names])
    spread = np.asarray([found[f"{v}_stddev_pop"] or 1.0 for v in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (np.stack([np.asarray(batch.column(2 + k)) for k in range(DIMENSIONS)], 1) - mean) / spread
            # The logistic curve at 1.702 z is the normal distribution within a hundredth.
            grid = np.clip((1 << BITS) / (1 + np.exp(-np.clip(1.702 * z, -40, 40))), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(grid))], ["row", "tokens", "place"])

    return rows.select("row", "tokens", *names).mapInArrow(run, "row long, tokens long, place long")


def _positions(places: DataFrame) -> DataFrame:
    """(row, position): tokens before each row in order of place. Ranges are of (place, row), so
    that copies, which share their place, are split among tasks; each task sums along its
    own range, and the driver adds up one number a range."""
    partitions = max(2, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            tokens = np.asarray(batch.column(1))
            sums = before + np.cumsum(tokens)
            before = int(sums[-1]) if len(sums) else before
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums - tokens), batch.column(1), batch.column(2)], ["row", "inside", "tokens", "part"])

    ordered = places.repartitionByRange(partitions, "place", "row").sortWithinPartitions("place", "row")
    inside = stored(ordered.select("row", "tokens", F.spark_partition_id().alias("part")).mapInArrow(run, "row long, inside long, tokens long, part int"), "packing-order")
    sums = sorted(inside.groupBy("part").agg(F.sum("tokens")).collect())
    base, bases = 0, []
    for part, n in sums:
        bases.append((part, base))
        base += n
    bases = places.sparkSession.createDataFrame(bases, "part int, base long")
    return inside.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("inside")).alias("position"), F.lit(base).alias("whole"))


def cuts(position: int, tokens: int, whole: int, length: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of the pieces of a document that begins at ``position`` of a
    stream of ``whole`` tokens. Full sequences come first; what is left at the end of the
    stream is cut to falling powers of two, which need no padding either."""
    full, out, last = whole // length, [], position + tokens
    while position < last and position < full * length:
        offset = position % length
        take = min(length - offset, last - position)
        out.append((position // length, offset, take))
        position += take
    start, sequence, rest = full * length, full, whole % length
    while rest and position < last:
        size = 1 << rest.bit_length() - 1
        if position < start + size:
            take = min(start + size, last) - position
            out.append((sequence, position - start, take))
            position += take
        start, sequence, rest = start + size, sequence + 1, rest - size
    return out


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) for each piece: ``ids``
    are its tokens as little-endian 32-bit integers, ``start`` those of its document before it.

    Every document, with ``end`` after it, is cut where sequences of ``length`` (a power of two)
    end; the last sequences are shorter powers of two, so nothing is padded. Null text
    is empty: one piece with ``end`` alone. Rows that repeat an id, or have none, are documents
    of their own; equal texts lie side by side, in order of their rows. An empty table
    has no pieces. Very long texts take as many sequences as they fill.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = encoded(docs, tokenizer, ranks, end)
    at = _positions(_places(rows))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(encoder(tokenizer, ranks).size, end)
        out, held = [], 0
        for batch in batches:
            for doc_id, ids, position, whole in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids = np.frombuffer(ids.as_py(), kind).astype("<u4")
                start = 0
                for sequence, offset, take in cuts(position.as_py(), len(ids), whole.as_py(), length):
                    piece = ids[start : start + take].tobytes()
                    out.append((doc_id.as_py(), start, take, zlib.crc32(piece), len(ids), sequence, offset, piece))
                    start, held = start + take, held + take
                    if held >= FLUSH_TOKENS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    met = rows.select("row", "doc_id", "ids").join(at, "row").select("doc_id", "ids", "position", "whole")
    return met.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids): the pieces of each sequence joined in order; at most one
    sequence length in a row."""
    part = F.struct("offset", "ids", "length")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("tokens"), F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"))
