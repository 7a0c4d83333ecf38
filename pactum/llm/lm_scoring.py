"""LM scoring: the marginal probability of a text over all its segmentations.

The vocabulary is fixed and its scores give every piece a first weight. Words of the
training documents, counted over the whole corpus, turn these into piece
probabilities by one expectation step: each word adds its expected piece uses over
all its segmentations. A text's probability is the product of its words' marginals
(forward recursion, rescaled with the logarithm of the scale carried beside it) and
that of its end, because no piece crosses words.

The public vocabulary used here is a BPE model: its scores are negative merge ranks, not
log-probabilities, which is why they only give first weights. A character that is no
piece has the fixed weight UNKNOWN beside the pieces' probabilities, which sum to one
without it; for texts of known characters the word model is thus a distribution up to
that weight.

The lattice runs once per distinct word, wherever Spark has dealt that word.
Texts then need word scores: the commonest words (at most DICTIONARY of them, of more than
WORD_BYTES bytes by their digests) go to the tasks by broadcast, all others meet their
texts in a shuffle join, which for this reason has no hot key.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored
from .lattice import PieceTable, rank_prior, vocabulary

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DICTIONARY, WORD_BYTES = 1 << 18, 64
#: Distinct words that a counting task holds before it passes them on.
HOLD = 400_000
#: Copies of a row that a task makes at a time.
COPIES = 4_096
HELD_OUT = 1
#: Weight of a character that is no piece, as part of the probability of its word.
UNKNOWN = 1e-12


@dataclass
class Model:
    train_tokens: int  # words and ends
    distinct: int
    train_docs: int
    end: float  # natural log of the probability that a text ends
    go_on: float
    table: PieceTable
    weights: np.ndarray


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, train, rest) over all of ``docs`` (text, held_out): uses in either part."""

    def run(batches):
        counts = (Counter(), Counter())

        def out():
            words = list(counts[0].keys() | counts[1].keys())
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([c[w] for w in some], pa.int64()) for c in counts)], ["word", "train", "rest"])
            for c in counts:
                c.clear()

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                counts[held].update(_words(text.as_py()))
                if len(counts[0]) + len(counts[1]) > HOLD:
                    yield from out()
        yield from out()

    return docs.mapInArrow(run, "word binary, train long, rest long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("rest").alias("rest"))


def _decode(words: pa.Array) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in words.to_pylist()]


def fit(words: DataFrame, train_docs: int, vocabulary_path: str = VOCABULARY) -> Model:
    """Piece probabilities from all training words; what returns is one row a piece."""
    spark = words.sparkSession
    pieces = vocabulary(vocabulary_path)
    table = PieceTable([p for _, p, _ in pieces])
    prior = rank_prior([s for *_, s in pieces])
    shared = spark.sparkContext.broadcast((table, prior))

    def expect(batches):
        table, prior = shared.value
        total = np.zeros(table.n)
        for batch in batches:
            total += table.expected_counts(_decode(batch.column("word")), batch.column("train").to_numpy().astype(float)[:, None], prior, UNKNOWN)[:, 0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "n"])

    sums = words.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count(F.when(F.col("train") > 0, 1)).alias("v")).first()
    rows = words.filter("train > 0").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(table.n)
    counts[rows["piece"]] = rows["n"]
    weights = counts + 0.01 * table.n * prior
    end = (train_docs + 0.5) / (train_docs + counts.sum() + 1.0)
    return Model(sums["n"] + train_docs, sums["v"] + (train_docs > 0), train_docs, math.log(end), math.log1p(-end), table, weights / weights.sum())


def score_words(words: DataFrame, model: Model) -> DataFrame:
    """``words`` with ``lp``: log10 of the word's probability over all segmentations; each
    piece also pays for the text going on."""
    shared = words.sparkSession.sparkContext.broadcast((model.table, model.weights * math.exp(model.go_on)))

    def run(batches):
        table, weights = shared.value
        for batch in batches:
            lp = table.log_marginals(_decode(batch.column("word")), weights[:, None], UNKNOWN)[:, 0] if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp / math.log(10))], [*batch.schema.names, "lp"])

    return words.mapInArrow(run, "word binary, train long, rest long, lp double")


def _entry(word: bytes) -> bytes:
    """The word as the dictionary of common words holds it."""
    return word if len(word) <= WORD_BYTES else b" " + hashlib.md5(word).digest()


def _common(scored: DataFrame) -> tuple[dict, np.ndarray, np.ndarray]:
    """The commonest words, by steps of frequency, as far as DICTIONARY reaches."""
    step = F.floor(F.log2(F.col("train") + F.col("rest")) * 8)
    # A space stands in no word, so a digest behind one is no other word.
    digest = F.concat(F.lit(b" "), F.unhex(F.md5("word")))
    short = scored.withColumns({"step": step, "word": F.when(F.length("word") <= WORD_BYTES, F.col("word")).otherwise(digest)})
    held, least = 0, None
    for r in sorted(short.groupBy("step").count().collect(), reverse=True):
        held += r["count"]
        if held > DICTIONARY:
            break
        least = r["step"]
    if least is None:
        return {}, np.empty(0, np.int64), np.empty(0)
    rows = short.filter(F.col("step") >= least).select("word", "train", "lp").toArrow()
    return {w: i for i, w in enumerate(rows.column(0).to_pylist())}, rows.column(1).to_numpy(), rows.column(2).to_numpy()


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are words and one end a text; null text has the end only. Learns from the
    documents outside the held-out fold and scores all. Each row gives a row, repeated ones
    too; texts meet their words under 128 bits of id and text. Extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    words = stored(count_words(docs), "lm-words")
    train_docs = docs.filter("not held_out").count()
    model = fit(words, train_docs)
    scored = stored(score_words(words, model), "lm-scored")
    places, uses, lps = _common(scored)
    divisor = model.train_tokens + 0.5 * (model.distinct + 1)
    base = lambda c: np.log10((c + 0.5) / divisor)
    shared = spark.sparkContext.broadcast((places, uses, base(uses), lps, float(base(train_docs)), model.end / math.log(10), train_docs))
    names = ["key", "word", "times", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        places, uses, bases, lps, base_end, lp_end, n_ends = shared.value
        find, rows = places.get, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for doc_id, text, held in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                ws = _words(text := text.as_py())
                at = np.fromiter((find(w if len(w) <= WORD_BYTES else _entry(w), -1) for w in ws), np.int64, len(ws))
                key = xxhash.xxh3_128_digest(f"{doc_id}\0{'' if text is None else text}".encode("utf-8", "surrogatepass"))
                known = at[at >= 0]
                # A text's own row meets no word: words hold no space.
                rows.append((key, b" " + key, 0, doc_id, held, len(ws) + 1, int((uses[known] > 0).sum()) + (n_ends > 0), float(bases[known].sum()) + base_end, float(lps[known].sum()) + lp_end))
                if len(known) < len(ws):
                    rest = Counter(ws[i] for i in np.flatnonzero(at < 0))
                    rows += [(key, w, n, None, None, 0, 0, 0.0, 0.0) for w, n in rest.items()]
                if len(rows) >= 20_000:
                    yield out()
                    rows = []
        if rows:
            yield out()

    parts = docs.mapInArrow(run, "key binary, word binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    met = parts.join(scored.select("word", "train", "lp"), "word", "left")
    base_rest = F.log10((F.col("train") + 0.5) / F.lit(float(divisor)))
    own = F.col("times") == 0
    sums = met.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.bool_or("held_out").alias("held_out"), F.count(F.when(own, 1)).alias("m"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(own, F.col("n_known")).otherwise(F.when(F.col("train") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.when(own, F.col("base_score")).otherwise(F.col("times") * base_rest)).alias("base_score"),
        F.sum(F.when(own, F.col("score")).otherwise(F.col("times") * F.col("lp"))).alias("score"),
    )
    each = lambda c, kind: (F.col(c) / F.col("m")).cast(kind).alias(c)
    # Repeated rows in two steps, so that no array grows with their number by itself.
    sums = sums.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(COPIES))))
    sums = sums.withColumn("row", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "m") - 1)))
    return sums.select("doc_id", "held_out", each("n_tokens", "long"), each("n_known", "long"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), each("base_score", "double"), each("score", "double"))
