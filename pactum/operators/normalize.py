"""Whole-document normalisation; offsets of everything later refer to its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

PAGE_NUMBER = r"(?iu)^-?\s*(sayfa\s*)?\d{1,3}\s*(/\s*\d{1,3})?\s*-?$"


def clean_characters(text: Column) -> Column:
    """Line ends, soft hyphens, no-break spaces, runs of blanks, blanks at line ends."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(F.translate(text, "­", ""), "[ \t ]+", " ")
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def looks_like_furniture(line: Column) -> Column:
    """Short, no sentence: at most 70 characters and 9 words, no closing ``!?:;``, and no
    closing dot after a lower-case word of three letters or more."""
    words = F.regexp_count(line, F.lit(r"\S+"))
    last = F.regexp_extract(line, r"(?U)(\w+)\.$", 1)
    sentence = (F.length(last) >= 3) & (last == F.lower(last))
    return (F.length(line) <= 70) & (words <= 9) & ~line.rlike("[!?:;]$") & ~sentence


def looks_like_heading(line: Column) -> Column:
    return line.rlike(r"(?iu)^\s*(madde|article|ek)\s*[-\s]*\d")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): every line with its place."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def repeated_lines(docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """(key, line, n, noisy): counts of trimmed lines of 4 to 89 characters in a document,
    and whether a line repeats often enough and looks like page furniture. Counting is
    partial before the shuffle, so a line that fills a document stays cheap."""
    lines = lines_of(docs, key, text).withColumn("line", F.trim("line"))
    total = F.size(F.split(F.col(text), "\n"))
    least = docs.select(key, F.greatest(F.lit(4), F.floor(total / 120)).alias("least"))
    counted = lines.filter(F.length("line").between(4, 89)).groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"))
    noisy = (F.col("n") >= F.col("least")) & ~looks_like_heading(F.col("line")) & looks_like_furniture(F.col("line"))
    return counted.join(least, key).withColumn("noisy", noisy).drop("least")


def drop_furniture(lines: Column) -> Column:
    """Lines without repeated page furniture and page numbers, within one array.

    A sorted line that repeats stands ``least`` places further on again, so repeats are
    found in one pass over the sorted lines that look like furniture.
    """
    trimmed = F.transform(lines, lambda x: F.trim(x))
    likely = F.array_sort(F.filter(trimmed, lambda x: F.length(x).between(4, 89) & ~looks_like_heading(x) & looks_like_furniture(x)))
    least = F.greatest(F.lit(4), F.floor(F.size(lines) / 120)).cast("int")
    noisy = let(F.struct(likely.alias("a"), least.alias("n")), lambda v: F.array_distinct(F.filter(v["a"], lambda x, i: F.get(v["a"], i + v["n"] - 1) == x)))
    return let(noisy, lambda z: F.filter(lines, lambda x: ~F.array_contains(z, F.trim(x)) & ~F.trim(x).rlike(PAGE_NUMBER)))


def dehyphenate(text: Column) -> Column:
    """Joins a word cut at a line end to a next line that begins in lower case."""
    return F.regexp_replace(text, r"(?U)(\w)-\n[ \t]*(\p{Ll})", "$1$2")


def normalize(text: Column) -> Column:
    """All steps, at most one empty line in a row, trimmed. Null stays null."""
    kept = let(F.split(clean_characters(text), "\n"), drop_furniture)
    # Mere strings tell which texts have anything to join or to leave out.
    out = let(F.array_join(kept, "\n"), lambda t: F.when(F.contains(t, F.lit("-\n")), dehyphenate(t)).otherwise(t))
    out = let(out, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def page_map(pages: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, page, text) with ``start`` and ``end``: places in the pages joined by newlines."""
    w = Window.partitionBy(key).orderBy("page")
    length = F.length("text") + 1
    end = F.sum(length).over(w)
    return pages.withColumn("start", (end - length).cast("long")).withColumn("end", (end - 1).cast("long"))
