"""Clauses and gap-free units of a document, as intervals over its normalised text.

One shuffle by document: lines get offsets from a running sum, headings open
sections by a running count, and the few sections of a document are folded and tiled
in its own row. Lines are never gathered beyond their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING_MARK = "[[H]]"
#: Longest heading, least paragraph, what counts as a tiny body.
MAX_HEADING, MIN_PARAGRAPH, TINY = 160, 80, 40
_TAIL = r"\s*[-–—.:)]?\s*(.*)$"
#: Heading forms, the most specific first; group 1 is the number.
HEADINGS = [
    ("madde", r"(?iu)^\s*MADDE\s+(\d+(?:\.\d+)*)" + _TAIL),
    ("ek", r"(?iu)^\s*(EK\s*[-–]?\s*\d+|EKLER)" + _TAIL),
    ("article", r"(?iu)^\s*(?:Article|Clause|Section)\s+(\d+(?:\.\d+)*)" + _TAIL),
    ("numeric", r"^\s*(\d+(?:\.\d+){0,3})\s*[.)]\s+(.*)$"),
    ("bare", r"^\s*(\d+(?:\.\d+){1,3})\s+(\S.*)$"),
    ("roman", r"^\s*([IVXLC]{1,6})\s*[.)]\s+(\S.*)$"),
]
NO_HEADING = r"(?iu)^\s*(?:\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\d+(?:[.,]\d{3})*(?:[.,]\d+)?\s*(?:%|TL|USD|EUR|₺|\$)|\d+\s*$)"
SIGNATURES = r"(?iu)\b(imza|kaşe|mühür)"


def looks_like_title(s: Column) -> Column:
    """Short, no closing ``.;,``, mostly capitals or a capital first with at most 12 words."""
    letters, capitals = (F.length(F.regexp_replace(s, rf"\P{{{c}}}", "")) for c in ("L", "Lu"))
    return (F.length(s).between(1, MAX_HEADING)) & ~s.rlike("[.;,]$") & (letters > 0) & ((capitals / letters > 0.55) | (s.rlike(r"^\p{Lu}") & (F.regexp_count(s, F.lit(r"\S+")) <= 12)))


def heading(line: Column) -> Column:
    """struct<kind, number, heading>, or null where the line is no heading. A line with the
    forced mark skips the checks on length and look."""
    bare = F.trim(line)
    forced = F.startswith(bare, F.lit(HEADING_MARK))
    s = F.when(forced, F.trim(F.substring(bare, len(HEADING_MARK) + 1, 1_000_000))).otherwise(bare)
    tries = []
    for kind, pattern in HEADINGS:
        number, title = F.trim(F.regexp_extract(s, pattern, 1)), F.trim(F.regexp_extract(s, pattern, 2))
        ok = s.rlike(pattern)
        if kind in ("numeric", "bare", "roman"):
            fits = F.length(title) <= MAX_HEADING
            if kind == "numeric":
                fits &= F.contains(number, F.lit(".")) | looks_like_title(title)
            if kind == "roman":
                fits &= looks_like_title(title)
            ok &= forced | fits
        tries.append(F.when(ok, F.struct(F.lit(kind).alias("kind"), number.alias("number"), F.substring(title, 1, 400).alias("heading"))))
    return F.when((F.length(bare).between(1, 400)) & ~s.rlike(NO_HEADING), F.coalesce(*tries))


def line_offsets(docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """(key, pos, line, char_start): every line with its offset in code points."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    return lines.withColumn("char_start", (F.sum(F.length("line") + 1).over(w) - F.length("line") - 1).cast("int"))


def _sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mode, length, parts): runs of lines with their heading, in order."""
    w = Window.partitionBy(key)
    ordered = w.orderBy("pos")
    lines = line_offsets(docs, key, text).withColumn("h", heading(F.col("line")))
    opens = F.col("h").isNotNull()
    lines = lines.withColumns({"titled": F.count(F.when(opens, 1)).over(w) >= 3, "length": F.max(F.col("char_start") + F.length("line")).over(w)})
    blank = F.trim("line") == ""
    lines = lines.withColumn("run", F.count(F.when(F.when(F.col("titled"), opens).otherwise(blank), 1)).over(ordered))
    runs = lines.groupBy(key, "titled", "length", "run").agg(
        F.coalesce(F.min(F.when(F.col("titled") | ~blank, F.col("char_start"))), F.min("char_start")).alias("start"),
        F.min_by("h", "pos").alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"),
    )
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    h = F.when(F.col("titled"), F.col("h"))
    clause = F.when(F.col("titled"), h.isNotNull()).otherwise(F.length(body) > MIN_PARAGRAPH)
    level = F.when(h["kind"] == "ek", 1).otherwise(F.length(h["number"]) - F.length(F.replace(h["number"], F.lit("."))) + 1)
    part = F.struct(
        "start", (~clause).alias("is_gap"), F.coalesce(h["kind"], F.lit("paragraf")).alias("kind"), F.coalesce(h["number"], F.lit("")).alias("number"),
        F.coalesce(h["heading"], F.lit("")).alias("heading"), F.coalesce(level, F.lit(1)).alias("level"), body.alias("text"),
    )
    return runs.groupBy(key, "titled", "length").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def units(docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """One row a unit: (key, order_index, kind, number, heading, text, level, char_start, char_end, is_gap).

    With three headings or more, sections run from heading to heading; else
    paragraphs of over 80 characters are clauses, numbered in order. Bodies under 40
    characters that follow each other are one clause (it grows as it absorbs).
    Everything else is a gap unit, and blank stretches join the unit before, so the
    intervals tile the text. Empty and null texts have no units.
    """
    docs = docs.filter(F.col(text).isNotNull() & (F.col(text) != ""))

    def grow(state, x):
        last = F.element_at(state, -1)
        both_tiny = F.col("titled") & ~x["is_gap"] & ~last["is_gap"] & (F.length(x["text"]) < TINY) & (F.length(last["text"]) < TINY)
        joined = last.withField("text", F.concat(last["text"], F.when(F.col("titled"), F.lit("\n")).otherwise(F.lit("\n\n")), x["text"]))
        merged = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(joined))
        return (
            F.when((F.length(x["text"]) < 2) & x["is_gap"], state)
            .when(F.size(state) == 0, F.array(x))
            .when(F.try_element_at(state, F.lit(-1))["is_gap"] & x["is_gap"] | both_tiny, merged)
            .otherwise(F.concat(state, F.array(x)))
        )

    sections = _sections(docs, key, text)
    kind = sections.schema["parts"].dataType.simpleString()
    folded = sections.select(key, "titled", "length", F.aggregate("parts", F.array().cast(kind), grow).alias("u"))
    rows = folded.select(key, "titled", "length", F.posexplode("u").alias("order_index", "x"))
    # Neighbours by window over the same grouping, so rows stay where they are and carry one unit each.
    ordered = Window.partitionBy(key, "titled", "length").orderBy("order_index")
    after = F.lead("x.start").over(ordered)
    first_line = F.substring(F.trim(F.split_part("x.text", F.lit("\n"), F.lit(1))), 1, 80)
    label = F.when(F.col("order_index") == 0, F.lit("Başlık ve taraflar")).when(after.isNull() & F.col("x.text").rlike(SIGNATURES), F.lit("İmza bloğu")).otherwise(first_line)
    paragraph = F.count_if(~F.col("x.is_gap")).over(ordered)
    return rows.select(
        key, "order_index", F.when(F.col("x.is_gap"), F.lit("gap")).otherwise(F.col("x.kind")).alias("kind"),
        F.when(F.col("x.is_gap"), F.lit("")).when(F.col("titled"), F.col("x.number")).otherwise(paragraph.cast("string")).alias("number"),
        F.when(F.col("x.is_gap"), label).otherwise(F.col("x.heading")).alias("heading"), F.col("x.text").alias("text"), F.col("x.level").alias("level"),
        F.when(F.col("order_index") == 0, F.lit(0)).otherwise(F.col("x.start")).alias("char_start"), F.coalesce(after, F.col("length")).alias("char_end"), F.col("x.is_gap").alias("is_gap"),
    )


def clauses(docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """The units that are clauses, renumbered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("char_start")) - 1
    return units(docs, key, text).filter("not is_gap").withColumn("order_index", rank)


def coverage_violations(unit_rows: DataFrame, docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """(key, at, problem): gaps, overlaps and uncovered ends. Empty when units tile the text."""
    w = Window.partitionBy(key).orderBy("char_start", "char_end")
    reach = F.coalesce(F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = unit_rows.withColumn("reach", reach)
    inner = inner.filter("char_start != reach").select(key, F.col("char_start").alias("at"), F.when(F.col("char_start") > F.col("reach"), "gap").otherwise("overlap").alias("problem"))
    ends = unit_rows.groupBy(key).agg(F.max("char_end").alias("end"))
    sizes = docs.filter(F.col(text).rlike(r"\S")).select(key, F.length(text).alias("length"))
    short = sizes.join(ends, key, "left").filter(F.coalesce("end", F.lit(0)) != F.col("length")).select(key, F.coalesce("end", F.lit(0)).alias("at"), F.lit("end").alias("problem"))
    return inner.unionByName(short)


def sections_between(lines: DataFrame, opens: Column, key: str = "contract_id") -> DataFrame:
    """(key, pos, line, char_start, char_end): each line that opens a section, to the next one or
    the end of the document. ``lines`` as ``line_offsets`` gives them."""
    end = F.max(F.col("char_start") + F.length("line")).over(Window.partitionBy(key))
    heads = lines.withColumn("end_", end).filter(opens)
    after = F.lead("char_start").over(Window.partitionBy(key).orderBy("pos"))
    return heads.select(key, "pos", "line", "char_start", F.coalesce(after, F.col("end_")).alias("char_end"))


def paragraphs(text: Column, least: int = MIN_PARAGRAPH) -> Column:
    """Blocks between empty lines that are longer than ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.trim(b)), lambda b: F.length(b) > least)


def uncovered(unit_rows: DataFrame, docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """(key, start, end): the stretches of each text that no unit covers, for any table of intervals:
    overlapping, out of order, beyond the text's ends, or none. Units are clipped to the text,
    and a running maximum of their ends finds what lies between."""
    sizes = docs.select(key, F.coalesce(F.length(text), F.lit(0)).alias("length")).filter("length > 0")
    held = unit_rows.join(sizes, key).select(key, F.greatest(F.col("char_start"), F.lit(0)).alias("s"), F.least("char_end", "length").alias("e")).filter("s < e")
    # The end of the text as an empty unit, so that what is uncovered there is a gap like others.
    ends = sizes.select(key, F.col("length").alias("s"), F.col("length").alias("e"))
    w = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = held.unionByName(ends).withColumn("start", F.coalesce(F.max("e").over(w), F.lit(0)))
    return rows.filter("start < s").select(key, "start", F.col("s").alias("end"))
