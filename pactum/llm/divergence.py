"""Source divergence audit: how far apart the sources of a language are, and by which terms.

Terms of a language that stand in its sources equally often have the same sparse vector of
counts. They are grouped by it, each pair of sources is evaluated once a distinct vector,
and the value counts as often as terms share the vector. Vectors are few against terms:
most terms are rare.

All arithmetic is on integers: shares are parts of 10^9, and what would not fit a long
on its way goes through decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import stored

UNIT, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 3, 200
#: Distinct terms, and sums of pairs, that a task holds before it passes them on; cells of a block.
HELD_TERMS, HELD_CELLS, BLOCK_CELLS = 1 << 18, 1 << 21, 1 << 17


def _per(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative numbers."""
    return F.call_function("div", a, b)


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 1) / size), exact for any long."""
    return 1 + _per(F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), size.cast("decimal(20,0)"))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares fit a long."""
    return _per((p - q) * (p - q), q)


#: Letters to lower case, all other ASCII to blanks, the rest as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term and documents that hold it. Tasks count
    by dictionary, in bytes: term characters are letters and all that is no ASCII, so UTF-8
    is cut only between characters. What a task holds is bounded; Spark sums the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        entries = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group, text in zip(zip(langs, sources, strict=True), batch.column(2), strict=True):
                terms = text.as_py().translate(_FOLD).split()
                uses, docs = held.get(group) or held.setdefault(group, (Counter(), Counter()))
                entries -= len(uses)
                uses.update(terms)
                docs.update(set(terms))
                entries += len(uses)
                if entries >= HELD_TERMS:
                    yield from _emit(held)
                    held, entries = {}, 0
        yield from _emit(held)

    rows = docs.select("lang", "source", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _emit(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (uses, docs) in held.items():
        terms = pa.array(list(uses), pa.binary()).cast(pa.string())
        k = len(terms)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), terms, pa.array(list(uses.values()), pa.int64()), pa.array([docs[t] for t in uses], pa.int64())], ["lang", "source", "term", "n", "docs"])


def count_vectors(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, vector): terms in at least ``least_docs`` documents of the language, with
    their counts by source in order of sources, sources without the term left out."""
    entry = F.struct("source", "n")
    found = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(entry)).alias("vector"))
    return found.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "vector")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of a language.

    Part ``pair``: every other source of the language by its divergence, summed over all
    kept terms. Part ``term``: the terms that the source uses more than its language, by
    what they add, the first ``top`` of them. Equal values go by item.

    Null text, lang and source are empty strings; rows that repeat count as often. A
    source without terms has pairs like any other; a language without kept terms has
    pairs of value 0; a language of one source has no rows; the empty table gives none.
    The pairs returned grow with the square of the sources of a language, as asked for, and so
    does the work on a distinct vector; what a task holds does not.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), "text")
    kept = stored(count_vectors(term_counts(docs), least_docs), "divergence-terms")
    groups, langs = _sizes(docs, kept)
    return _pairs(kept, groups).unionByName(_terms(kept, groups, langs, top))


def _sizes(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, terms, size, zero) and languages (lang, whole): sizes are
    occurrences of kept terms plus the number of kept terms; ``zero`` is the share of a
    count of 0."""
    langs = stored(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("total")).select("lang", "terms", (F.col("total") + F.col("terms")).alias("whole")), "divergence-langs")
    held = kept.select("lang", F.explode("vector").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("held"))
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    terms = F.coalesce("terms", F.lit(0))
    size = F.coalesce("held", F.lit(0)) + terms
    groups = groups.select("lang", "source", terms.alias("terms"), size.alias("size"), F.when(size > 0, share(F.lit(0), size)).alias("zero"))
    return stored(groups, "divergence-groups"), langs.select("lang", "whole")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    vectors = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("alike"))
    sides = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size", "zero"))).alias("sides"))
    # Shares of all sources, once a distinct vector, in order of sources.
    shares = let(F.map_from_entries("vector"), lambda n: F.transform("sides", lambda s: let(F.try_element_at(n, s["source"]), lambda c: F.when(c.isNull(), s["zero"]).otherwise(share(c, s["size"])))))
    found = vectors.join(sides, "lang").select("lang", "alike", shares.alias("shares")).mapInArrow(_pair_sums, "lang string, i int, j int, value long")
    found = found.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    named = sides.select("lang", F.posexplode("sides").alias("i", "x")).select("lang", "i", "x.source")
    other = named.select("lang", F.col("i").alias("j"), F.col("source").alias("item"))
    every = named.join(other, "lang").filter("i != j").join(found, ["lang", "i", "j"], "left")
    return _ranked(every.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, alike, shares) to (lang, i, j, value): divergence of side i from side j, summed over
    the vectors of a task. Sums of squares over shares that add up to 10^9 fit a long."""
    held: dict = {}
    cells = 0
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes, alike = langs.indices.to_numpy(), batch.column(1).to_numpy()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            at = np.flatnonzero(codes == code)
            rows = batch.column(2).take(pa.array(at))
            all_shares, weights = rows.flatten().to_numpy().reshape(len(at), -1), alike[at]
            width = all_shares.shape[1]
            block = max(1, BLOCK_CELLS // width)
            for start in range(0, len(at), block):
                q, w = all_shares[start : start + block], weights[start : start + block]
                for i in range(width):
                    more = w @ ((q[:, i : i + 1] - q) ** 2 // q)
                    if (lang, i) in held:
                        held[lang, i] += more
                    else:
                        held[lang, i], cells = more, cells + width
                    if cells >= HELD_CELLS:
                        yield from _sums(held)
                        held, cells = {}, 0
    yield from _sums(held)


def _sums(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, i), values in held.items():
        k = len(values)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(np.full(k, i, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(values)], ["lang", "i", "j", "value"])


def _terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    rows = kept.select("lang", "term", "total", F.explode("vector").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    rows = rows.join(groups.select("lang", "source", "size"), ["lang", "source"]).join(langs, "lang")
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("size")).alias("p"), share(F.col("total"), F.col("whole")).alias("q")).filter("p > q")
    # Spark keeps the first of each group before the shuffle (window group limit).
    return _ranked(rows.select("lang", "source", F.lit("term").alias("part"), "item", excess(F.col("p"), F.col("q")).alias("value"))).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
