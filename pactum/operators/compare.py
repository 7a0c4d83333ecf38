"""Version comparison: every old and every new unit appears once among the changes.

Candidate pairs are made and scored by Spark inside a comparison; only the choice
among scored pairs (greedy, best first) needs a comparison's candidates together.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.text import fold, quote_found

#: Thresholds of the alignment.
SAME, NUMBER, MOVED, GRAY, MAX_ASKED = 0.72, 0.35, 0.95, 0.45, 12
WORD = "[0-9A-Za-zÇĞİÖŞÜçğıöşü]+"
NUMBERS = r"\d+(?:[.,]\d+)*"
#: A type object, so that this module loads before there is a session.
WORD_DIFF = ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())]))


def tokens(text: Column) -> Column:
    """Words with the white space that follows, so joined tokens give back the text."""
    return F.regexp_extract_all(text, F.lit(r"(\S+\s*)"), F.lit(1))


def match_key(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(1))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    one = lambda x, y: (1.0 if not len(x) and not len(y) else 0.0) if not len(x) or not len(y) else SequenceMatcher(None, list(x), list(y)).ratio()
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column, where: Column | None = None) -> Column:
    """Matching-blocks ratio of the two key sequences; two empty ones are alike. Rows that
    ``where`` leaves out compare nothing and get 1."""
    x, y = match_key(a), match_key(b)
    if where is not None:
        none = F.array().cast("array<string>")
        x, y = F.when(where, x).otherwise(none), F.when(where, y).otherwise(none)
    return _ratio(x, y)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the ratio of two key sequences can be ``least``: matched keys are at most the
    shorter sequence, and none that the other sequence lacks."""
    both = F.size(a) + F.size(b)
    shared = F.least(F.size(a) - F.size(F.array_except(a, b)), F.size(b) - F.size(F.array_except(b, a)))
    return (2 * F.least(F.size(a), F.size(b)) >= least * both) & (2 * shared >= least * both)


def candidates(old: DataFrame, new: DataFrame, key: str, least: float) -> DataFrame:
    """(key, i, j) of the units whose ratio can be ``least``, by a join on rare words.

    ``old``: (key, i, ki), ``new``: (key, j, kj), with arrays of words. A ratio of ``least``
    needs ``least / 2`` of the words of both units in common, repeats counted, so at least
    ``least / (2 - least)`` of either. A word's n-th occurrence is an element; with a
    unit's elements ordered by how many units of the comparison hold them, rarest first, two
    such units share an element among the first ``n - need + 1`` of each. Only those are
    joined, so units that share nothing but common words never meet. Units without
    words meet each other.
    """
    def elements(units: DataFrame, side: int, at: str) -> DataFrame:
        words = F.when(F.size(f"k{at}") > 0, F.col(f"k{at}")).otherwise(F.array(F.lit("")))
        each = units.select(key, F.lit(side).alias("side"), F.col(at).alias("unit"), F.size(words).alias("n"), F.explode(words).alias("w"))
        held = each.groupBy(key, "side", "unit", "n", "w").agg(F.count(F.lit(1)).cast("int").alias("times"))
        return held.select(key, "side", "unit", "n", "w", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))

    every = elements(old, 0, "i").unionByName(elements(new, 1, "j"))
    every = every.withColumn("units", F.count(F.lit(1)).over(Window.partitionBy(key, "w", "nth")))
    every = every.withColumn("p", F.row_number().over(Window.partitionBy(key, "side", "unit").orderBy("units", "w", "nth")))
    need = F.ceil(F.col("n") * (least / (2 - least)) - 1e-9)
    first = every.filter(F.col("p") <= F.col("n") - need + 1)
    half = lambda side, at: first.filter(F.col("side") == side).select(key, "w", "nth", F.col("unit").alias(at), F.col("n").alias(f"n{at}"), F.col("p").alias(f"p{at}"))
    both = F.col("ni") + F.col("nj")
    # Of the first element that two units share, this is all that can follow.
    rest = 1 + F.least(F.col("ni") - F.col("pi"), F.col("nj") - F.col("pj"))
    met = half(0, "i").join(half(1, "j"), [key, "w", "nth"]).filter((2 * rest >= least * both - 1e-9) & (2 * F.least("ni", "nj") >= least * both - 1e-9))
    return met.select(key, "i", "j").distinct()


@F.pandas_udf(WORD_DIFF)
def _diff(a: pd.Series, b: pd.Series, fa: pd.Series, fb: pd.Series) -> pd.Series:
    def one(x, y, kx, ky):
        out: list[list[str]] = []
        for tag, i, j, k, m in SequenceMatcher(None, list(kx), list(ky)).get_opcodes():
            for op, piece in (("equal", x[i:j]),) if tag == "equal" else (("delete", x[i:j]), ("insert", y[k:m])):
                if len(piece):
                    if out and out[-1][0] == op:
                        out[-1][1] += "".join(piece)
                    else:
                        out.append([op, "".join(piece)])
        return [{"op": op, "text": t} for op, t in out]

    return pd.Series([one(*row) for row in zip(a, b, fa, fb, strict=True)])


def word_diff(old: Column, new: Column) -> Column:
    """array<struct<op, text>>; equal + delete rebuilds old, equal + insert rebuilds new."""
    x, y = tokens(old), tokens(new)
    return _diff(x, y, F.transform(x, fold), F.transform(y, fold))


def significant(diff: Column) -> Column:
    """Whether a word, not only white space or punctuation, was removed or added."""
    return F.exists(diff, lambda d: (d["op"] != "equal") & d["text"].rlike(WORD))


def _body(number: Column, text: Column, is_gap: Column) -> Column:
    """The text without its first line, where that line carries the number."""
    first, rest = F.split_part(text, F.lit("\n"), F.lit(1)), F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1)
    return F.when(~is_gap & (number != "") & F.contains(first, number) & (F.trim(rest) != ""), rest).otherwise(text)


def _greedy(key: str):
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used_i, used_j, kept = set(), set(), []
        for row in pdf.sort_values(["s", "i", "j"], ascending=[False, True, True]).itertuples():
            if row.i not in used_i and row.j not in used_j:
                used_i.add(row.i)
                used_j.add(row.j)
                kept.append(row.Index)
        return pdf.loc[kept, [key, "i", "j", "adjudicated"]]

    return choose


def align(old: DataFrame, new: DataFrame, key: str = "comparison_id", verdicts: DataFrame | None = None) -> DataFrame:
    """The change list of each comparison, in order.

    ``old`` and ``new``: (key, order_index, number, heading, text, is_gap). Numbers that
    are single on both sides match from similarity 0.35; what is left matches greedily
    from 0.72; ``verdicts`` (key, i, j, same) may settle the best gray pair of an old unit,
    at most twelve a comparison. No verdict means no match, never a lost unit.
    """
    cols = ["number", "heading", "text", "is_gap"]
    o = old.select(key, F.col("order_index").alias("i"), *[F.col(c).alias(f"old_{c}") for c in cols])
    n = new.select(key, F.col("order_index").alias("j"), *[F.col(c).alias(f"new_{c}") for c in cols])
    once = lambda side, c: (F.count(F.lit(1)).over(Window.partitionBy(key, F.trim(c))) == 1) & (F.trim(c) != "")
    ou, nu = (d.withColumn("once", once(d, c)) for d, c in ((o, "old_number"), (n, "new_number")))
    by_number = ou.filter("once").join(nu.filter("once").drop("once"), (ou[key] == nu[key]) & (F.trim("old_number") == F.trim("new_number"))).select(ou[key].alias(key), "i", "j", similarity(F.col("old_text"), F.col("new_text")).alias("s")).filter(F.col("s") >= NUMBER).select(key, "i", "j")
    free_o, free_n = o.join(by_number, [key, "i"], "left_anti"), n.join(by_number, [key, "j"], "left_anti")
    keyed = lambda side, at, c: side.select(key, at, match_key(F.col(c)).alias(f"k{at}"))
    # Few pairs meet, and bounds on the ratio leave fewer to be compared in full.
    words_o, words_n = keyed(free_o, "i", "old_text"), keyed(free_n, "j", "new_text")
    pairs = candidates(words_o, words_n, key, GRAY).join(words_o, [key, "i"]).join(words_n, [key, "j"]).filter(may_reach(F.col("ki"), F.col("kj"), GRAY))
    pairs = pairs.select(key, "i", "j", _ratio("ki", "kj").alias("s")).filter(F.col("s") >= GRAY)
    schema = f"{key} {dict(old.dtypes)[key]}, i int, j int, adjudicated boolean"
    close = pairs.filter(F.col("s") >= SAME).withColumn("adjudicated", F.lit(False)).groupBy(key).applyInPandas(_greedy(key), schema)
    matched = by_number.withColumn("adjudicated", F.lit(False)).unionByName(close)
    if verdicts is not None:
        left = pairs.filter(F.col("s") < SAME).join(close, [key, "i"], "left_anti").join(close, [key, "j"], "left_anti")
        best = left.withColumn("r", F.row_number().over(Window.partitionBy(key, "i").orderBy(F.desc("s"), "j"))).filter("r = 1")
        asked = best.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("s"), "i", "j"))).filter(F.col("r") <= MAX_ASKED)
        agreed = asked.join(verdicts.filter("same"), [key, "i", "j"], "left_semi").withColumn("adjudicated", F.lit(True))
        matched = matched.unionByName(agreed.select(key, "i", "j", "s", "adjudicated").groupBy(key).applyInPandas(_greedy(key), schema))
    full = o.join(matched, [key, "i"], "left").join(n, [key, "j"], "full")
    before = F.last("j", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col("i").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    both, gone = F.col("i").isNotNull() & F.col("new_text").isNotNull() & F.col("old_text").isNotNull(), F.col("new_text").isNull()
    full = full.withColumn("place", F.when(gone, F.coalesce(before, F.lit(-1)) + 0.5).otherwise(F.col("j").cast("double")))
    empty = F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit(""))
    full = full.withColumns({"diff": word_diff(*empty), "similarity": F.when(both, similarity(*empty, where=both)).otherwise(0.0)})
    renumbered = both & (F.trim("old_number") != F.trim("new_number"))
    moved = similarity(where=renumbered, a=_body(F.col("old_number"), empty[0], F.coalesce("old_is_gap", F.lit(False))), b=_body(F.col("new_number"), empty[1], F.coalesce("new_is_gap", F.lit(False))))
    full = full.withColumns({"moved": moved, "significant": significant(F.col("diff"))})
    kind = F.when(gone, "SILINDI").when(~both, "EKLENDI").when(~F.col("significant"), "AYNI").when(renumbered & (F.col("moved") >= MOVED), "TASINDI").otherwise("DEGISTI")
    order = F.row_number().over(Window.partitionBy(key).orderBy("place", F.col("i").asc_nulls_last())) - 1
    return full.withColumn("change_type", kind).select(
        key, order.alias("order_index"), "change_type", "i", F.when(~gone, F.col("j")).alias("j"), "old_number", "new_number", "old_heading", "new_heading", "old_text", "new_text",
        "similarity", F.when(F.col("change_type") == "AYNI", F.array().cast("array<struct<op:string,text:string>>")).otherwise(F.col("diff")).alias("word_diff"),
        "significant", F.coalesce("new_is_gap", "old_is_gap").alias("is_gap_unit"), F.coalesce("adjudicated", F.lit(False)).alias("adjudicated"),
    )


def change_stats(changes: DataFrame, key: str = "comparison_id") -> DataFrame:
    n = lambda cond: F.count_if(cond)
    kinds = ["EKLENDI", "SILINDI", "DEGISTI", "TASINDI", "AYNI"]
    return changes.groupBy(key).agg(*[n(F.col("change_type") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("toplam"), n(F.col("significant") & (F.col("change_type") != "AYNI")).alias("onemli"))


def diff_summary(diff: Column, limit: int = 300) -> Column:
    """struct<removed, added>: the texts taken out and put in, each cut at ``limit``."""
    part = lambda op: F.substring(F.array_join(F.transform(F.filter(diff, lambda d: d["op"] == op), lambda d: F.trim(d["text"])), " … "), 1, limit)
    return F.struct(part("delete").alias("removed"), part("insert").alias("added"))


def materiality(change_type: Column, significant_: Column, diff: Column) -> Column:
    """Weight of a change without a model: text that comes or goes is high, numbers that
    change too, moves are low, the rest is medium."""
    numbers = F.exists(diff, lambda d: (d["op"] != "equal") & d["text"].rlike(r"\d"))
    return F.when((change_type == "AYNI") | ~significant_, "YOK").when(change_type == "TASINDI", "DUSUK").when(change_type.isin("EKLENDI", "SILINDI") | numbers, "YUKSEK").otherwise("ORTA")


def template_explanation(change_type: Column, heading: Column, diff: Column) -> Column:
    s = diff_summary(diff)
    name = F.coalesce(F.nullif(heading, F.lit("")), F.lit("-"))
    return (
        F.when(change_type == "EKLENDI", F.concat(name, F.lit(": added"))).when(change_type == "SILINDI", F.concat(name, F.lit(": removed")))
        .when(change_type == "TASINDI", F.concat(name, F.lit(": moved"))).when(change_type == "AYNI", F.concat(name, F.lit(": unchanged")))
        .otherwise(F.concat(name, F.lit(": \""), s["removed"], F.lit("\" became \""), s["added"], F.lit("\"")))
    )


def anchors_hold(explanation: Column, old: Column, new: Column, quote: Column | None = None) -> Column:
    """Every number of the explanation occurs in the old or new text, and the quote if given."""
    source = F.concat_ws("\n", old, new)
    numbers = F.regexp_extract_all(F.coalesce(explanation, F.lit("")), F.lit(f"({NUMBERS})"), F.lit(1))
    ok = F.size(F.filter(numbers, lambda x: ~F.contains(source, x))) == 0
    return ok if quote is None else ok & (quote.isNull() | quote_found(source, quote))


def triage(changes: DataFrame, verdicts: DataFrame, key: str = "comparison_id") -> DataFrame:
    """Model verdicts (key, order_index, materiality, impact, explanation) over defaults: an
    omission keeps the row and its default; an unknown impact becomes neutral."""
    base = changes.withColumn("materiality_", materiality(F.col("change_type"), F.col("significant"), F.col("word_diff")))
    impact = F.when(F.col("impact").isin("LEHE", "ALEYHE", "NOTR"), F.col("impact")).otherwise("NOTR")
    text = F.coalesce("explanation", template_explanation(F.col("change_type"), F.coalesce("new_heading", "old_heading"), F.col("word_diff")))
    held = anchors_hold(F.col("explanation"), F.col("old_text"), F.col("new_text"))
    fallback = template_explanation(F.col("change_type"), F.coalesce("new_heading", "old_heading"), F.col("word_diff"))
    out = base.join(verdicts.select(key, "order_index", "materiality", "impact", "explanation"), [key, "order_index"], "left")
    return out.withColumns({"materiality": F.coalesce("materiality", "materiality_"), "impact": impact, "verification": F.when(F.col("explanation").isNull(), "TEMPLATE").when(held, "VERIFIED").otherwise("REJECTED"), "explanation": F.when(F.coalesce(held, F.lit(False)), text).otherwise(fallback)}).drop("materiality_")
