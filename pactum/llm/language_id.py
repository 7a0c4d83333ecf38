"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
text's likelihood under a language is the product over its letter runs of the
weight of all their segmentations, summed by the forward algorithm. Model size is
vocabulary times languages, whatever the corpus; prediction is one narrow pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, let_go
from .lattice import PieceTable, rank_prior, vocabulary

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the sample that piece probabilities are fitted on, per language.
TRAIN_DOCS_PER_LANG = 4000
UNKNOWN = 1e-8
#: Characters of text that one lattice pass takes; bounds the memory of a task.
PASS_CHARS = 1_000_000
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    langs: list[str]
    table: PieceTable
    weights: np.ndarray  # [piece][language]


def _passes(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Slices of batches with the letter runs of each text, at most PASS_CHARS at a time
    (one longer text still comes whole)."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= PASS_CHARS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), [LETTERS.findall((x or "").lower()) for x in texts[start : i + 1]]
                start, held = i + 1, 0


def _distinct(runs: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    seen: dict[str, int] = {}
    codes = [seen.setdefault(w, len(seen)) for ws in runs for w in ws]
    return np.asarray(codes, np.int64), list(seen)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", bound: int = TRAIN_DOCS_PER_LANG, vocabulary_path: str = VOCABULARY) -> Model:
    """Piece probabilities per language, from at most about ``bound`` documents of each.

    The sample takes documents by a hash of their id, so it is spread over the
    table and the same in every run. One EM step from the vocabulary's own scores
    gives expected piece counts; tasks return counts, never texts.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], PieceTable(["\0"]), np.zeros((1, 0)))
    below = spark.createDataFrame([(k, math.ceil(min(1.0, bound / n) * (1 << 20))) for k, n in sizes.items()], "lang string, below long")
    sample = known.join(F.broadcast(below), "lang").filter("h < below").select("lang", "text")
    pieces = vocabulary(vocabulary_path)
    table = PieceTable([p for _, p, _ in pieces])
    prior = rank_prior([s for *_, s in pieces])
    shared = spark.sparkContext.broadcast((table, prior, {x: i for i, x in enumerate(langs)}))

    def count(batches):
        let_go()
        table, prior, at = shared.value
        total = np.zeros((table.n, len(at)))
        for batch, runs in _passes(batches, "text"):
            codes, words = _distinct(runs)
            if words:
                col = np.repeat([at[x] for x in batch.column("lang").to_pylist()], [len(r) for r in runs])
                times = np.zeros((len(words), len(at)))
                np.add.at(times, (codes, col), 1.0)
                total += table.expected_counts(words, times, prior, UNKNOWN)
        piece, col = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(col, pa.int32()), pa.array(total[piece, col])], ["piece", "col", "n"])

    rows = sample.mapInArrow(count, "piece int, col int, n double").groupBy("piece", "col").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((table.n, len(langs)))
    counts[rows["piece"], rows["col"]] = rows["n"]
    weights = counts + 0.05 * table.n * prior[:, None]
    return Model(langs, table, weights / weights.sum(axis=0))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (posterior under equal priors).

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing
    was learned. Equal posteriors take the first language by code point.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*kept)
    if not model.langs:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        let_go()
        m = shared.value
        for batch, runs in _passes(batches, text):
            codes, words = _distinct(runs)
            loglik = np.zeros((len(runs), len(m.langs)))
            lengths = np.asarray([len(r) for r in runs])
            if words:
                some = lengths > 0
                starts = (np.cumsum(lengths) - lengths)[some]
                loglik[some] = np.add.reduceat(m.table.log_marginals(words, m.weights, UNKNOWN)[codes], starts, axis=0)
            best = loglik.argmax(axis=1)
            post = 1.0 / np.exp(loglik - loglik.max(axis=1, keepdims=True)).sum(axis=1)
            pred = [m.langs[b] if n else "und" for b, n in zip(best, lengths, strict=True)]
            arrays = [*batch.columns, pa.array(pred, pa.string()), pa.array(np.where(lengths > 0, post, 0.0))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(score, f"{fields}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    return fold(F.col(key)) == 0


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the documents outside the held-out fold and predicts all of them."""
    train = docs.filter(~held_out())
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(slim, fit(train)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that language ID rejects: no letter to judge by, or a
    posterior under ``least``."""
    columns = docs.columns
    named = {c: f"in_{i}" for i, c in enumerate(columns)}
    judged = predict(docs.withColumnsRenamed(named), fit(docs.filter(~held_out())), text=named["text"])
    stays = judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return stays.select(*[F.col(new).alias(old) for old, new in named.items()])
