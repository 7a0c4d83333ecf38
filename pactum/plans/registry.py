"""Name -> query over the shared tables, and name -> DuckDB SQL that gives the same rows.

How tables stand in for what the operators are about: a contract is a document or an
order, a clause is a line of a document, a finding is a line item, a model call or an
audit entry is an event, a version pair is two assistant turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, compare, enrich, meta, normalize, portfolio, rules, scoring, segment
from ..sources.catalog import to_frame
from ..storage import dealt, stored
from ..streaming import throttle
from . import analysis
from .neutral import TYPES

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    """Texts are what takes time, so they are dealt to all cores."""
    return dealt(_t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _long(df: DataFrame) -> DataFrame:
    """Integers as longs, so that types agree with the SQL."""
    return df.select(*[F.col(c).cast("long") if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"
FOLD = r"trim(regexp_replace(translate(lower(translate({0}, 'İIŞĞÜÖÇ', 'iışğüöç')), '’‘“”', chr(39) || chr(39) || chr(34) || chr(34)), '[\s\x{{00a0}}]+', ' ', 'g'))"


# --- sources and text -------------------------------------------------------------------


@query(r"""SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size,
 regexp_replace(coalesce(source, '') || '/' || coalesce(lang, '') || ' ' || doc_id, '[^\w.\-]+', '_', 'g')[1:120] AS name,
 length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) < 120 AS thin FROM documents""")
def ingest_manifest(spark, sf_dir):
    """Content hash and size, safe name, thin text layer."""
    d = _t(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit(" "), F.col("doc_id"))
    return d.select("doc_id", F.sha2(body.cast("binary"), 256).alias("sha256"), F.octet_length(body).cast("long").alias("size"), T.safe_name(name).alias("name"), T.text_layer_too_thin(body, F.lit(1)).alias("thin"))


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded, length({FOLD.format('text')})::BIGINT AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def fold_normalise(spark, sf_dir):
    folded = T.fold(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(folded.cast("binary")).alias("folded"), F.length(folded).cast("long").alias("n"))


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, trim(line) AS line, count(*) AS n FROM l WHERE length(trim(line)) BETWEEN 4 AND 89 GROUP BY ALL),
 t AS (SELECT doc_id, greatest(4, count(*) // 120) AS least FROM l GROUP BY 1)
SELECT doc_id, line, n, n >= least AND NOT regexp_matches(line, '(?i)^\s*(madde|article|ek)\s*[-\s]*\d') AND length(line) <= 70 AND len(regexp_extract_all(line, '\S+')) <= 9
 AND NOT regexp_matches(line, '[!?:;]$') AND NOT (length(regexp_extract(line, '([\p{{L}}\p{{N}}_]+)\.$', 1)) >= 3 AND regexp_extract(line, '([\p{{L}}\p{{N}}_]+)\.$', 1) = lower(regexp_extract(line, '([\p{{L}}\p{{N}}_]+)\.$', 1))) AS noisy
FROM c JOIN t USING (doc_id)""")
def repeated_lines(spark, sf_dir):
    """Counts of repeated lines and which of them are page furniture."""
    return normalize.repeated_lines(_docs(spark, sf_dir), "doc_id")


@query(rf"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1)::BIGINT AS char_start, length(line)::BIGINT AS n FROM l")
def line_offsets(spark, sf_dir):
    return _long(segment.line_offsets(_docs(spark, sf_dir), "doc_id").select("doc_id", "pos", "char_start", F.length("line").alias("n")))


@query(rf"""WITH {LINES}, o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS char_start FROM l),
 e AS (SELECT *, max(char_start + length(line)) OVER (PARTITION BY doc_id) AS fin FROM o), h AS (SELECT * FROM e WHERE length(line) BETWEEN 1 AND 60)
SELECT doc_id, pos::BIGINT AS pos, char_start::BIGINT AS char_start, coalesce(lead(char_start) OVER (PARTITION BY doc_id ORDER BY pos), fin)::BIGINT AS char_end FROM h""")
def sections_by_heading(spark, sf_dir):
    """Short lines open sections; each runs to the next."""
    lines = segment.line_offsets(_docs(spark, sf_dir), "doc_id")
    return _long(segment.sections_between(lines, F.length("line").between(1, 60), "doc_id").drop("line"))


@query(rf"""WITH {LINES}, o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS e, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
 t AS (SELECT doc_id, pos, e - length(line) - 1 AS s, e - CASE WHEN pos = n - 1 THEN 1 ELSE 0 END + CASE WHEN pos % 11 = 5 THEN 4 ELSE 0 END AS e FROM o WHERE pos % 7 <> 3),
 r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM t),
 m AS (SELECT doc_id, max(e) AS e FROM t GROUP BY 1)
SELECT doc_id, s::BIGINT AS "at", CASE WHEN s > reach THEN 'gap' ELSE 'overlap' END AS problem FROM r WHERE s <> reach
UNION ALL SELECT d.doc_id, coalesce(m.e, 0)::BIGINT, 'end' FROM documents d LEFT JOIN m USING (doc_id) WHERE regexp_matches(d.text, '\S') AND coalesce(m.e, 0) <> length(d.text)""")
def coverage_violations(spark, sf_dir):
    """Lines as units, of which every seventh is left out and every eleventh runs too far: each
    gap, overlap and uncovered end is found."""
    docs = _docs(spark, sf_dir)
    lines = segment.line_offsets(docs, "doc_id")
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("doc_id"))
    end = F.col("char_start") + F.length("line") + F.when(last, 0).otherwise(1) + F.when(F.col("pos") % 11 == 5, 4).otherwise(0)
    units = lines.withColumn("char_end", end).filter("pos % 7 != 3").select("doc_id", "char_start", "char_end")
    return _long(segment.coverage_violations(units, docs, "doc_id"))


@query(rf"""WITH {LINES}, o AS (SELECT doc_id, pos, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS s, length(line) AS n FROM l),
 d AS (SELECT doc_id, length(text) AS length FROM documents WHERE length(text) > 0),
 u AS (SELECT doc_id, greatest(s - pos % 5 * 3, 0) AS s, least(s + n + pos % 4 * 9, length) AS e FROM o JOIN d USING (doc_id) WHERE pos % 3 <> 1),
 x AS (SELECT doc_id, s, e FROM u WHERE s < e UNION ALL SELECT doc_id, length, length FROM d),
 r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM x)
SELECT doc_id, reach::BIGINT AS "start", s::BIGINT AS "end" FROM r WHERE reach < s""")
def uncovered_intervals(spark, sf_dir):
    """What units leave uncovered that overlap, reach over both ends of the text, and of which a third
    is missing."""
    docs = _docs(spark, sf_dir)
    lines = segment.line_offsets(docs, "doc_id").filter("pos % 3 != 1")
    units = lines.select("doc_id", (F.col("char_start") - F.col("pos") % 5 * 3).alias("char_start"), (F.col("char_start") + F.length("line") + F.col("pos") % 4 * 9).alias("char_end"))
    return _long(segment.uncovered(units, docs, "doc_id"))


_HEAD = "[-–—.:)]"
_TITLE = "(length({0}) BETWEEN 1 AND 160 AND NOT regexp_matches({0}, '[.;,]$') AND length(regexp_replace({0}, '\\P{{L}}', '', 'g')) > 0 AND (length(regexp_replace({0}, '\\P{{Lu}}', '', 'g')) / length(regexp_replace({0}, '\\P{{L}}', '', 'g'))::DOUBLE > 0.55 OR (regexp_matches({0}, '^\\p{{Lu}}') AND len(regexp_extract_all({0}, '\\S+')) <= 12)))"
_FORMS = {
    "madde": rf"(?i)^\s*MADDE\s+(\d+(?:\.\d+)*)\s*{_HEAD}?\s*(.*)$", "ek": rf"(?i)^\s*(EK\s*[-–]?\s*\d+|EKLER)\s*{_HEAD}?\s*(.*)$",
    "article": rf"(?i)^\s*(?:Article|Clause|Section)\s+(\d+(?:\.\d+)*)\s*{_HEAD}?\s*(.*)$", "numeric": r"^\s*(\d+(?:\.\d+){0,3})\s*[.)]\s+(.*)$",
    "bare": r"^\s*(\d+(?:\.\d+){1,3})\s+(\S.*)$", "roman": r"^\s*([IVXLC]{1,6})\s*[.)]\s+(\S.*)$",
}
_OK = {
    "madde": "true", "ek": "true", "article": "true", "bare": "length(t_bare) <= 160", "roman": "length(t_roman) <= 160 AND " + _TITLE.format("t_roman"),
    "numeric": "length(t_numeric) <= 160 AND (contains(n_numeric, '.') OR " + _TITLE.format("t_numeric") + ")",
}
_NO_HEAD = r"(?i)^\s*(?:\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\d+(?:[.,]\d{3})*(?:[.,]\d+)?\s*(?:%|TL|USD|EUR|₺|\$)|\d+\s*$)"


_HEADED = """CASE pos % 8 WHEN 0 THEN 'MADDE ' || (pos + 1) || ' - ' || line WHEN 1 THEN 'EK-' || (pos + 1) || ': ' || line WHEN 2 THEN 'Article ' || (pos + 1) || '.2 ' || line WHEN 3 THEN (pos + 1) || '. ' || substring(line, 1, 40)
 WHEN 4 THEN (pos + 1) || '.1 ' || line WHEN 5 THEN 'IV. ' || substring(line, 1, 30) WHEN 6 THEN '12.05.2024 ' || line ELSE line END"""


@query(rf"""WITH {LINES}, n AS (SELECT doc_id, pos, {_HEADED} AS line FROM l), g AS (SELECT doc_id, pos, trim(line) AS s, {", ".join(f"trim(regexp_extract(trim(line), '{p}', 1)) AS n_{k}, trim(regexp_extract(trim(line), '{p}', 2)) AS t_{k}" for k, p in _FORMS.items())} FROM n),
 k AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(s, '{p}') AND {_OK[k]} THEN '{k}'" for k, p in _FORMS.items())} END AS kind FROM g WHERE length(s) BETWEEN 1 AND 400 AND NOT regexp_matches(s, '{_NO_HEAD}'))
SELECT doc_id, pos::BIGINT AS pos, kind, CASE kind {" ".join(f"WHEN '{k}' THEN n_{k}" for k in _FORMS)} END AS number, CASE kind {" ".join(f"WHEN '{k}' THEN t_{k}" for k in _FORMS)} END AS heading FROM k WHERE kind IS NOT NULL""")
def heading_lines(spark, sf_dir):
    """Lines that are headings, by the operator's own forms; the texts hold none, so lines are
    numbered in each form in turn, and every eighth begins with a date, which is no number."""
    lines = segment.line_offsets(_docs(spark, sf_dir), "doc_id").select("doc_id", "pos", T.let(F.expr(_HEADED), segment.heading).alias("h"))
    return _long(lines.filter("h is not null").select("doc_id", "pos", "h.kind", "h.number", "h.heading"))


@query(rf"""WITH {LINES}, o AS (SELECT doc_id, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS s, pos + 1 AS page FROM l), a AS (SELECT doc_id, 97 * k AS "at" FROM (SELECT doc_id, unnest(range(0, length(text) // 97 + 3)) AS k FROM documents WHERE text IS NOT NULL))
SELECT a.doc_id, a."at"::BIGINT AS "at", (SELECT max(page) FROM o WHERE o.doc_id = a.doc_id AND o.s <= a."at" AND a."at" <= o.s + o.n)::BIGINT AS page FROM a""")
def page_of_place(spark, sf_dir):
    """Lines taken as pages: on which of them every 97th place of a text lies, also past its end."""
    docs = _t(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    pages = normalize.page_map(normalize.lines_of(docs, "doc_id", "text").select("doc_id", (F.col("pos") + 1).alias("page"), F.col("line").alias("text")), "doc_id")
    places = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 97) + 2)).alias("k")).select("doc_id", (F.col("k") * 97).alias("at"))
    return _long(portfolio.page_of(places, pages, "doc_id"))


@query(r"""SELECT doc_id, len(p)::BIGINT AS n, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::BIGINT AS chars, md5(array_to_string(p, '|')) AS h
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: trim(x)), lambda x: length(x) > 80) AS p FROM documents)""")
def paragraph_fallback(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", segment.paragraphs(F.col("text")).alias("p"))
    chars = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return d.select("doc_id", F.size("p").cast("long").alias("n"), chars.alias("chars"), F.md5(F.array_join("p", "|").cast("binary")).alias("h"))


@query(rf"""WITH p AS (SELECT doc_id, pos + 1 AS page, line FROM (WITH {LINES} SELECT * FROM l))
SELECT doc_id, page::BIGINT AS page, (sum(length(line) + 1) OVER w - length(line) - 1)::BIGINT AS "start", (sum(length(line) + 1) OVER w - 1)::BIGINT AS "end" FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)""")
def page_map(spark, sf_dir):
    """Lines taken as pages: where each stands in the joined text."""
    pages = normalize.lines_of(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", (F.col("pos") + 1).alias("page"), F.col("line").alias("text"))
    return _long(normalize.page_map(pages, "doc_id").drop("text"))


# --- metadata ---------------------------------------------------------------------------

_AMOUNT = r"(?i)(\d{1,3}(?:[.\s]\d{3})+(?:,\d{1,2})?|\d+(?:,\d{1,2})?)\s*(TL|TRY|USD|EUR|€|\$|₺|Amerikan Dolar[ıi]|Avro|T[uü]rk Liras[ıi])"


@query(rf"""SELECT doc_id, trim(regexp_extract(coalesce(text, ''), '{_AMOUNT}', 1) || ' ' || regexp_extract(coalesce(text, ''), '{_AMOUNT}', 2)) AS value_text,
 regexp_matches({FOLD.format("coalesce(text, '')")}, '(kendiliğinden|otomatik olarak)[^.]{{0,40}}(yenilen|uzar)') AS auto_renew FROM documents""")
def amounts_and_flags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", meta.amount(F.col("text")).alias("value_text"), T.fold(F.col("text")).rlike(meta.RENEWS).alias("auto_renew"))


@query(r"""SELECT doc_id, len(t)::BIGINT AS n, array_to_string(list_sort(t), '|') AS terms FROM
(SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '"([^"\n]{2,45})"', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS t FROM documents)""")
def defined_terms(spark, sf_dir):
    """Quoted terms of whole texts, distinct."""
    terms = meta.defined_terms(F.col("text"), r'"([^"\n]{2,45})"', meta.GENERIC, 1_000_000_000)
    return _docs(spark, sf_dir).select("doc_id", terms.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), "|").alias("terms"))


# --- classification and rules ------------------------------------------------------------

_C = "[a-zçğıöşü]"
_I = lambda p: p.replace("i", "[iı]")  # noqa: E731  case folding takes dotted and dotless i as one; RE2 does not
_KEYWORDS = [(t.code, t.catalog_order, i, k) for t in TYPES for i, k in enumerate(t.keywords)]
_VALUES = ", ".join(f"('{c}', {o}, {i}, '{k}', '(^|[^a-zçğıöşü0-9])" + r"\s+".join(_I(w) + _C + "*" for w in k.split()) + "')" for c, o, i, k in _KEYWORDS)
_KW = f"""k(code, catalog_order, kw_pos, keyword, p) AS (VALUES {_VALUES}), {LINES},
 f AS (SELECT doc_id, pos AS order_index, line, {FOLD.format('line')} AS b FROM l),
 h AS (SELECT doc_id, order_index, code, catalog_order, kw_pos, keyword, len(regexp_extract_all(b, p)) AS n FROM f, k WHERE regexp_matches(b, p)),
 tot AS (SELECT doc_id, count(*) AS total FROM f GROUP BY 1),
 df AS (SELECT doc_id, keyword, count(*) AS n, any_value(total) AS total FROM h JOIN tot USING (doc_id) GROUP BY 1, 2),
 cm AS (SELECT doc_id, keyword FROM df WHERE total >= 8 AND n > 0.4 * total)"""
_LOW = "lower(translate({0}, 'İIŞĞÜÖÇ', 'iışğüöç'))"
_POSITIVE = [(t.code, t.catalog_order, r.id, r.severity, "(?is)" + "|".join(f"(?:{_I(p)})" for p in r.patterns)) for t in TYPES for r in t.red_lines if r.patterns]
_PATTERNS = "pt(code, catalog_order, rule_id, severity, p) AS (VALUES " + ", ".join(f"('{c}', {o}, '{i}', '{s}', '{p}')" for c, o, i, s, p in _POSITIVE) + ")"
_SCORE = f"""{_KW}, {_PATTERNS},
 w AS (SELECT doc_id, order_index, code, catalog_order, sum((1.0 + 0.5 * (length(keyword) - length(replace(keyword, ' ', ''))))::DOUBLE * (CASE WHEN cm.doc_id IS NULL THEN 1.0 ELSE 0.15 END)::DOUBLE * least(n, 3)) AS s
   FROM h LEFT JOIN cm USING (doc_id, keyword) GROUP BY 1, 2, 3, 4),
 o AS (SELECT DISTINCT doc_id, order_index, code, catalog_order, true AS hit FROM f, pt WHERE regexp_matches({_LOW.format('line')}, p)),
 s AS (SELECT doc_id, order_index, code, catalog_order, round(CASE WHEN coalesce(s, 0) < 1.5 AND hit THEN 2.5 ELSE coalesce(s, 0) END, 2) AS score FROM w FULL JOIN o USING (doc_id, order_index, code, catalog_order)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, order_index ORDER BY score DESC, catalog_order) AS rank, max(score) OVER (PARTITION BY doc_id, order_index) AS top FROM s WHERE score >= 1.5),
 sc AS (SELECT doc_id, order_index::BIGINT AS order_index, code, score, rank::BIGINT AS rank, round(least(0.99, 0.45 + 0.5 * score / top), 2)::DOUBLE AS confidence FROM r WHERE rank <= 4 AND score >= greatest(1.5, 0.35 * top))"""


def _clauses(spark, sf_dir):
    """Lines as clauses without a heading."""
    lines = normalize.lines_of(_docs(spark, sf_dir), "doc_id", "text")
    return lines.select("doc_id", F.col("pos").alias("order_index"), F.lit("").alias("heading"), F.col("line").alias("text"))


@query(f"WITH {_KW} SELECT doc_id, keyword, n, total, total >= 8 AND n > 0.4 * total AS common FROM df")
def keyword_doc_frequency(spark, sf_dir):
    """In how many of a document's clauses a keyword occurs, and whether it is a mere defined term."""
    clauses = _clauses(spark, sf_dir)
    hits = stored(classify.keyword_hits(clauses, TYPES, "doc_id"), "keyword-frequency")
    n = hits.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n")).join(clauses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total")), "doc_id")
    common = classify.common_terms(hits, clauses, "doc_id").withColumn("c", F.lit(True))
    return n.join(common, ["doc_id", "keyword"], "left").select("doc_id", "keyword", "n", "total", F.coalesce("c", F.lit(False)).alias("common"))


@query(f"WITH {_SCORE} SELECT * FROM sc")
def clause_topk_types(spark, sf_dir):
    return _long(classify.score(_clauses(spark, sf_dir), TYPES, "doc_id"))


@query(f"WITH {_KW}, {_PATTERNS} SELECT DISTINCT doc_id, order_index::BIGINT AS order_index, code FROM f, pt WHERE regexp_matches({_LOW.format('line')}, p)")
def pattern_override(spark, sf_dir):
    """Clauses that a red-line pattern assigns to a type whatever their words."""
    return _long(classify.pattern_hits(_clauses(spark, sf_dir), TYPES, "doc_id").drop("catalog_order"))


def _classified(spark, sf_dir):
    return classify.classify(_clauses(spark, sf_dir), TYPES, "doc_id")


@query(f"WITH {_SCORE} SELECT f.doc_id, f.order_index::BIGINT AS order_index, pt.code, rule_id, severity FROM f JOIN sc ON f.doc_id = sc.doc_id AND f.order_index = sc.order_index JOIN pt ON pt.code = sc.code WHERE regexp_matches({_LOW.format('line')}, p)")
def positive_red_lines(spark, sf_dir):
    """Rules violated by wording; the neutral texts hold no sentence that would turn one round."""
    return _long(rules.positive_red_lines(_classified(spark, sf_dir), TYPES, "doc_id").select("doc_id", "order_index", "code", "rule_id", "severity"))


_SEPARATORS = (". ", ".\n", "\n\n", "; ")
_RULES = [(t.code, r) for t in TYPES for r in t.red_lines if r.patterns]


def _match_sql(rule, end: bool) -> str:
    """Where the first of a rule's patterns that matches begins or ends, in DuckDB's words."""
    at = lambda p: f"length(regexp_extract(low, '(?is)^(.*?)(?:{_I(p)})', 1))" + (f" + length(regexp_extract(low, '(?is){_I(p)}'))" if end else "")
    return "CASE " + " ".join(f"WHEN regexp_matches(low, '(?is){_I(p)}') THEN {at(p)}" for p in rule.patterns) + " END"


def _sql_text(x: str) -> str:
    return " || ".join(f"'{part}'" for part in x.split("\n")).replace(" || ", " || chr(10) || ")


_LEFT = " ".join(f"WHEN strpos(reverse(before), reverse({_sql_text(x)})) > 0 THEN s - strpos(reverse(before), reverse({_sql_text(x)})) + 1" for x in _SEPARATORS)


@query(rf"""WITH {_SCORE}, c AS (SELECT doc_id, order_index, line || CASE WHEN order_index % 3 = 0 THEN '; yasaktır' ELSE '' END AS t FROM f), lc AS (SELECT *, {_LOW.format('t')} AS low FROM c),
 m AS ({" UNION ALL ".join(f"SELECT lc.*, '{c}' AS code, '{r.id}' AS rule_id, {_match_sql(r, False)} AS s, {_match_sql(r, True)} AS e FROM lc" for c, r in _RULES)}),
 rh AS (SELECT m.*, substring(t, greatest(0, s - 420) + 1, s - greatest(0, s - 420)) AS before, substring(t, e + 1, 420) AS after FROM m JOIN sc USING (doc_id, order_index, code) WHERE s IS NOT NULL),
 p AS (SELECT *, CASE {_LEFT} ELSE greatest(0, s - 160) END AS "start", e + CASE WHEN regexp_matches(after, '(?s)^(.*?(?:[.;]\s|

))') THEN length(regexp_extract(after, '(?s)^(.*?(?:[.;]\s|

))', 1)) ELSE least(length(after), 200) END AS "end" FROM rh)
SELECT doc_id, order_index::BIGINT AS order_index, code, rule_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end", trim(substring(t, "start" + 1, "end" - "start")) AS quote FROM p WHERE NOT contains(substring(t, "start" + 1, "end" - "start"), 'yasaktır')""")
def red_line_sentences(spark, sf_dir):
    """The sentence of each red line and its place; every third clause ends in a sentence that
    forbids, which turns round what stands in the same sentence and nothing else."""
    clauses = _clauses(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("order_index") % 3 == 0, "; yasaktır").otherwise("")))
    found = rules.positive_red_lines(classify.classify(clauses, TYPES, "doc_id"), TYPES, "doc_id")
    return _long(found.select("doc_id", "order_index", "code", "rule_id", "start", "end", "quote"))


@query(f"""WITH {_SCORE}, scopes AS (SELECT f.doc_id, code, min(f.order_index) AS first_clause, string_agg(line, chr(10) ORDER BY f.order_index) AS scope FROM f JOIN sc ON f.doc_id = sc.doc_id AND f.order_index = sc.order_index GROUP BY 1, 2),
 ab(code, rule_id, severity, p) AS (VALUES {", ".join(f"('{t.code}', '{r.id}', '{r.severity}', '(?is){_I(p)}')" for t in TYPES for r in t.red_lines for p in r.absent_patterns)})
SELECT doc_id, first_clause::BIGINT AS order_index, code, rule_id, severity FROM scopes JOIN ab USING (code) WHERE NOT regexp_matches({_LOW.format('scope')}, p)""")
def absence_red_lines(spark, sf_dir):
    """Protections found in no clause of their type."""
    return _long(rules.absent_red_lines(_classified(spark, sf_dir), TYPES, "doc_id").select("doc_id", "order_index", "code", "rule_id", "severity"))


_PHRASES = ("of the", "in the", "und die", "de la")


@query(f"SELECT doc_id, phrase FROM (SELECT doc_id, {FOLD.format('coalesce(text, chr(32))')} AS b FROM documents), (VALUES {', '.join(f'({p!r})' for p in _PHRASES)}) AS p(phrase) WHERE contains(b, phrase)")
def ambiguous_phrases(spark, sf_dir):
    """Phrases of a dictionary that stand in a text."""
    found = rules.ambiguous(F.col("text"), None, _PHRASES, ())
    return _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.phrase")


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '(?i)version\s+(\d+)', 1), lambda x: x::BIGINT),
 lambda x: NOT list_contains(list_transform(regexp_extract_all(t, '(?im)^\s*version\s+(\d+)', 1), lambda y: y::BIGINT), x)))), ',') AS missing FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def dangling_references(spark, sf_dir):
    """Numbers referred to that head no line."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(rules.missing_annexes(F.col("text"), r"(?i)version\s+(\d+)", r"(?im)^\s*version\s+(\d+)").cast("array<string>"), ",").alias("missing"))


def _events(spark, sf_dir):
    """Events as model calls; NTZ times become instants of the session's UTC."""
    e = _t(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_timestamp(F.col("ts")))


@query("""WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS t0 FROM events), o AS (SELECT *, CASE WHEN t0 - lag(t0) OVER (PARTITION BY user_id ORDER BY t0) < 240 THEN 0 ELSE 1 END AS opens FROM e),
 b AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS block FROM o)
SELECT user_id, block::BIGINT AS block, min(t0) AS "start", max(t0) AS "end", count(*) AS n FROM b GROUP BY 1, 2""")
def near_match_blocks(spark, sf_dir):
    """Places nearer than 240 to each other are one block."""
    e = _events(spark, sf_dir).select("user_id", "at", F.col("at").alias("until"))
    return _long(rules.near_blocks(e, "user_id", "at", "until"))


_SEV = "CASE WHEN l_discount >= 0.08 THEN 'KRITIK' WHEN l_discount >= 0.06 THEN 'YUKSEK' WHEN l_discount >= 0.04 THEN 'ORTA' WHEN l_discount >= 0.02 THEN 'DUSUK' ELSE 'BILGI' END"
_RANK = "list_position(['BILGI', 'DUSUK', 'ORTA', 'YUKSEK', 'KRITIK'], severity)"
_KIND = "CASE l_returnflag WHEN 'R' THEN 'RED_LINE' WHEN 'A' THEN 'AMBIGUOUS' ELSE 'WEAK' END"


def _findings(spark, sf_dir):
    """Line items as findings."""
    i = _t(spark, sf_dir, "lineitem")
    return i.withColumns({"severity": F.expr(_SEV), "finding_type": F.expr(_KIND), "confidence": F.col("l_tax") * 10, "lens": F.col("l_linestatus")})


@query(f"""WITH f AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_linestatus, l_tax * 10 AS confidence, {_SEV} AS severity FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_RANK} DESC, confidence DESC, l_linenumber) AS r, string_agg(DISTINCT l_linestatus, ', ') OVER (PARTITION BY l_orderkey, l_returnflag) AS ls FROM f)
SELECT l_orderkey, l_returnflag, l_linenumber::BIGINT AS l_linenumber, severity, list_aggregate(list_sort(string_split(ls, ', ')), 'string_agg', ', ') AS lens FROM r WHERE r = 1""")
def dedupe_findings(spark, sf_dir):
    out = rules.dedupe(_findings(spark, sf_dir), ["l_orderkey", "l_returnflag"], "l_linenumber")
    return _long(out.select("l_orderkey", "l_returnflag", "l_linenumber", "severity", "lens"))


@query(f"""WITH {_SCORE}, m(code, sev, ks) AS (VALUES ('LICENSING', 'YUKSEK', ['license', 'licensed under', 'version']), ('SECRETS', 'DUSUK', ['token', 'password'])),
 g AS (SELECT doc_id, code, sev, len(list_filter(ks, lambda k: contains({FOLD.format("coalesce(text, '')")}, k))) AS hits FROM documents, m WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.doc_id = documents.doc_id AND sc.code = m.code))
SELECT doc_id, code, hits::BIGINT AS hits, CASE WHEN hits < 1 THEN 'YOK' ELSE 'KISMEN' END AS status, CASE WHEN hits < 1 THEN sev ELSE 'ORTA' END AS severity FROM g""")
def mandatory_gaps(spark, sf_dir):
    """Mandatory types that no clause of a document has."""
    docs = _docs(spark, sf_dir).withColumn("contract_type", F.lit("SAAS"))
    detected = classify.score(_clauses(spark, sf_dir), TYPES, "doc_id").select("doc_id", "code").distinct()
    return _long(scoring.detect_gaps(docs, to_frame(spark, TYPES), detected, "doc_id").select("doc_id", "code", "hits", "status", "severity"))


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), b AS (SELECT item_id AS k, text AS q FROM benchmark)
SELECT doc_id, length(q) >= 12 AND (contains(coalesce(text, ''), q) OR contains({FOLD.format("coalesce(text, '')")}, {FOLD.format('q')})) AS found FROM documents, n JOIN b ON b.k = documents.doc_id % n.n""")
def quote_grounding(spark, sf_dir):
    """Each document is claimed to hold one benchmark passage; the claim is checked."""
    claims = _t(spark, sf_dir, "benchmark").select(F.col("text").alias("q"), F.col("item_id").alias("k"))
    docs = _docs(spark, sf_dir).withColumn("k", F.col("doc_id") % claims.count())
    return docs.join(claims, "k").select("doc_id", T.quote_found(F.col("text"), F.trim("q")).alias("found"))


_CLAIM = """CASE doc_id % 4 WHEN 0 THEN substring(t, 1 + CAST(floor(length(t) / 3) AS INT), 60) WHEN 1 THEN 'no text holds these words ' || doc_id
 ELSE replace(translate(substring(t, 1 + CAST(floor(length(t) / 2) AS INT), 70), 'abcdefghjklmnopqrstuvwxyz', 'ABCDEFGHJKLMNOPQRSTUVWXYZ'), ' ', {0}) END"""
_STRIPPED = r"trim(trim(trim(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'), chr(34)), '«»'), '“”')"


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), 'e ', 'e' || chr(160) || chr(10) || ' ', 'g') AS t FROM documents), c AS (SELECT doc_id, t, {_CLAIM.format("'  '")} AS q FROM d),
 b AS (SELECT doc_id, t, {_STRIPPED.format('q')} AS q FROM c),
 f AS (SELECT *, {FOLD.format('t')} AS ft, {FOLD.format('q')} AS fq, string_split(regexp_replace(translate(t, chr(160), ' '), '\s', ' ', 'g'), '') AS c FROM b WHERE length(q) >= 12),
 k AS (SELECT *, list_filter(range(len(c)), lambda i: c[i + 1] <> ' ' OR (i > 0 AND c[i] <> ' ')) AS places FROM f)
SELECT doc_id, (CASE WHEN contains(t, q) THEN strpos(t, q) - 1 ELSE places[strpos(ft, fq)] END)::BIGINT AS "start",
 (CASE WHEN contains(t, q) THEN strpos(t, q) - 1 + length(q) ELSE places[strpos(ft, fq) + length(fq) - 1] + 1 END)::BIGINT AS "end" FROM k WHERE contains(t, q) OR contains(ft, fq)""")
def quote_spans(spark, sf_dir):
    """Where a quote stands that was taken from a text as it is, in capitals with doubled blanks, or
    from nowhere; the texts have no-break spaces and line ends where they had a blank after e."""
    texts = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "e ", "e\u00a0\n ").alias("t"))
    found = texts.select("doc_id", T.quote_span(F.col("t"), F.expr(_CLAIM.format("'  '"))).alias("x"))
    return _long(found.filter("x is not null").select("doc_id", "x.*"))


# --- scoring and portfolio ----------------------------------------------------------------

_POINTS = "CASE severity WHEN 'KRITIK' THEN 5.0 WHEN 'YUKSEK' THEN 3.0 WHEN 'ORTA' THEN 1.5 WHEN 'DUSUK' THEN 0.6 ELSE 0.0 END::DOUBLE"
_SCORED = f"""f AS (SELECT l_orderkey, l_linenumber, l_partkey, {_SEV} AS severity, {_KIND} AS finding_type, l_tax * 10 AS confidence FROM lineitem),
 s AS (SELECT f.*, p_size, round({_POINTS} * (p_size % 5 + 1) * (CASE WHEN p_size % 3 = 0 THEN 1.25 ELSE 1.0 END)::DOUBLE * greatest(0.4, least(1.0, confidence))::DOUBLE, 2) AS score FROM f JOIN part ON p_partkey = l_partkey)"""


def _scored(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    f = _findings(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    category = F.when(F.col("p_size") % 3 == 0, "VERI_GUVENLIK").otherwise("TICARI_RISK")
    multiplier = scoring.context_multiplier(category, F.lit(True), F.lit(False))
    return f.withColumn("score", scoring.finding_score(F.col("severity"), F.col("p_size") % 5 + 1, multiplier, F.col("confidence")))


@query(f"WITH {_SCORED} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, severity, score FROM s")
def context_scored_lines(spark, sf_dir):
    return _long(_scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "severity", "score"))


_BANDS = f"""{_SCORED}, a AS (SELECT l_orderkey, sum(score::DECIMAL(18,2))::DOUBLE AS total, count(*) FILTER (finding_type = 'RED_LINE' AND severity IN ('KRITIK', 'YUKSEK')) AS red_lines FROM s GROUP BY 1),
 c AS (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(total, 0) AS total, coalesce(red_lines, 0) AS red_lines, round(greatest(0.0, 100.0::DOUBLE - 100.0::DOUBLE * coalesce(total, 0) / (coalesce(total, 0) + 180.0::DOUBLE)), 1) AS score FROM orders LEFT JOIN a ON l_orderkey = o_orderkey),
 bd AS (SELECT *, CASE WHEN red_lines > 0 OR score < 60 THEN 'KIRMIZI' WHEN score < 80 THEN 'SARI' ELSE 'YESIL' END AS band FROM c)"""


def _bands(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    findings = _scored(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", "score", "severity", "finding_type")
    return scoring.contract_scores(orders, findings, "o_orderkey")


@query(f"WITH {_BANDS} SELECT o_orderkey, total, red_lines, score, band FROM bd")
def contract_bands(spark, sf_dir):
    """Score, band and veto of every contract; one without findings scores 100."""
    return _bands(spark, sf_dir)


@query(f"""WITH f AS (SELECT l_orderkey, {_SEV} AS severity, {_KIND} AS t FROM lineitem) SELECT l_orderkey, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("BILGI", "DUSUK", "ORTA", "YUKSEK", "KRITIK"))}, 0::BIGINT AS missing FROM f GROUP BY 1""")
def severity_counts(spark, sf_dir):
    return scoring.severity_counts(_findings(spark, sf_dir), "l_orderkey")


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, {_SEV} AS severity, l_tax * 10 AS confidence FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, severity, row_number() OVER w AS rank FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_RANK} DESC, confidence DESC, l_linenumber) QUALIFY row_number() OVER w <= 5""")
def priority_actions(spark, sf_dir):
    """The five gravest findings of each contract."""
    from ..schemas import severity_rank

    out = scoring.top_per_group(_findings(spark, sf_dir), ["l_orderkey"], [F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), "l_linenumber"], 5)
    return _long(out.select("l_orderkey", "l_linenumber", "severity", "rank"))


@query(f"""WITH {_SCORE}, wt(code, w) AS (VALUES {", ".join(f"('{t.code}', {t.weight})" for t in TYPES)}), m AS (SELECT doc_id, order_index, max(w)::BIGINT AS weight FROM sc JOIN wt USING (code) GROUP BY 1, 2)
SELECT doc_id, order_index, weight, row_number() OVER w AS rank FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY weight DESC, order_index) QUALIFY row_number() OVER w <= 5""")
def llm_clause_selection(spark, sf_dir):
    """The five heaviest clauses of each document, as a model would be asked about them."""
    return _long(scoring.clauses_for_model(classify.codes_of(_clauses(spark, sf_dir), TYPES, "doc_id"), to_frame(spark, TYPES), "doc_id", 5))


_LENSES = {t.code: scoring.LENSES[t.category][: max(0, min(2, t.weight - 3))] for t in TYPES}
_EFFORT = {t.code: "xhigh" if t.weight >= 5 else {4: "high", 3: "medium"}.get(t.weight, "low") for t in TYPES}


def _list_sql(t) -> str:
    """A type's checklist, the lines of rules that match marked."""
    mark = lambda r: f" || CASE WHEN {' OR '.join(f'regexp_matches(low, {chr(39)}(?is){_I(p)}{chr(39)})' for p in r.patterns)} THEN ' (kural eşleşti)' ELSE '' END" if r.patterns else ""
    lines = [f"'{i}. [{r.severity}] {r.text}'{mark(r)}" for i, r in enumerate(t.red_lines, 1)]
    return "'Denetim listesi:' || chr(10) || " + " || chr(10) || ".join(lines) if lines else "NULL"


@query(f"""WITH {_SCORE}, wt(code, w, name, ob, effort, lenses) AS (VALUES {", ".join(f"('{t.code}', {t.weight}, '{t.name}', '{t.obligation}', '{_EFFORT[t.code]}', {['', *_LENSES[t.code]]})" for t in TYPES)}),
 mw AS (SELECT doc_id, order_index, max(w) AS weight FROM sc JOIN wt USING (code) GROUP BY 1, 2), pk AS (SELECT * FROM mw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, order_index) <= 3),
 x AS (SELECT sc.doc_id, sc.order_index, code, w, name, ob, effort, unnest(lenses) AS lens, line, {_LOW.format('line')} AS low FROM sc JOIN pk USING (doc_id, order_index) JOIN f USING (doc_id, order_index) JOIN wt USING (code)),
 q AS (SELECT *, concat_ws(chr(10), CASE WHEN lens <> '' THEN 'Bakış: ' || lens END, 'Madde', 'Tip: ' || code || ', ' || name || ', ağırlık ' || w || ', ' || ob, '<madde>', substring(line, 1, 12000), '</madde>', CASE code {" ".join(f"WHEN '{t.code}' THEN {_list_sql(t)}" for t in TYPES)} END) AS prompt FROM x)
SELECT doc_id, order_index::BIGINT AS order_index, code, lens, effort, length(prompt)::BIGINT AS n_chars, md5(prompt) AS prompt_md5 FROM q""")
def prompt_rows(spark, sf_dir):
    """What a model would be asked about the three heaviest clauses of each document: one row a
    clause, type and view. The marks on the checklist are those of the rules' own hits."""
    classified = stored(_classified(spark, sf_dir).filter(F.size("codes") > 0), "prompts-classified")
    hits = rules.positive_red_lines(classified, TYPES, "doc_id")
    rows = enrich.prompt_rows(classified, TYPES, to_frame(spark, TYPES), hits, "doc_id", 3)
    return _long(rows.select("doc_id", "order_index", "code", "lens", "effort", F.length("prompt").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")))


_VISIBLE = "v AS (SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice < 400000)"


def _visible(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    o = o.withColumns({"silindi_at": F.when(F.col("o_totalprice") >= 400000, F.col("o_orderdate")), "listede_gizli": F.col("o_orderstatus") == "P"})
    return portfolio.visible(o)


@query(f"""WITH {_VISIBLE}, f AS (SELECT l_orderkey, {_SEV} AS severity FROM lineitem)
SELECT o_orderkey, o_orderstatus, count(severity) AS n_total, {", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in ("BILGI", "DUSUK", "ORTA", "YUKSEK", "KRITIK"))} FROM v LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def visible_portfolio(spark, sf_dir):
    """Contracts neither deleted nor hidden, with their finding counts."""
    f = _findings(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", "severity")
    return portfolio.portfolio_rows(_visible(spark, sf_dir), f, "o_orderkey").select("o_orderkey", "o_orderstatus", "n_total", *[f"n_{s}" for s in portfolio.SEVERITIES])


@query(f"""WITH {_BANDS}, {_VISIBLE}, n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT bd.*, coalesce(n, 0) AS n_total, bd.o_orderstatus = 'F' AS done FROM bd JOIN v USING (o_orderkey) LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT count(*) AS n, count(*) FILTER (done) AS finished, {", ".join(f"count(*) FILTER (done AND band = '{b}') AS {b}" for b in ("YESIL", "SARI", "KIRMIZI"))}, round(avg(score) FILTER (done), 1) AS avg_score, sum(n_total)::BIGINT AS findings FROM r""")
def portfolio_summary(spark, sf_dir):
    rows = portfolio.portfolio_rows(_visible(spark, sf_dir), _findings(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", "severity"), "o_orderkey")
    rows = rows.join(_bands(spark, sf_dir).select("o_orderkey", "score", "band"), "o_orderkey")
    return portfolio.portfolio_summary(rows, "score", F.col("band"), F.col("o_orderstatus") == "F")


@query(f"SELECT p_brand, count(*) AS n FROM (SELECT l_partkey, {_SEV} AS severity FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE severity IN ('KRITIK', 'YUKSEK') GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8")
def top_violations(spark, sf_dir):
    """The eight codes violated most at the two highest severities."""
    f = _findings(spark, sf_dir).filter(F.col("severity").isin("KRITIK", "YUKSEK"))
    return portfolio.top_counts(f.join(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")), "p_brand", 8)


@query(f"WITH {_BANDS} SELECT c_name, round(avg(score), 1) AS avg_score, count(*) AS n FROM bd JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY avg_score, c_name LIMIT 6")
def riskiest_counterparties(spark, sf_dir):
    """Six counterparties of lowest mean score."""
    rows = _bands(spark, sf_dir).join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return portfolio.riskiest(rows, "c_name", "score", 6)


@query("SELECT o_orderpriority, grouping_id(c_mktsegment, o_orderpriority) AS level, c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def portfolio_rollup(spark, sf_dir):
    """Subtotals by segment and priority (an extension)."""
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return portfolio.rollup_counts(rows, ["c_mktsegment", "o_orderpriority"], "o_totalprice")


# --- usage, lineage, operations -------------------------------------------------------------

_CALLS = "c AS (SELECT event_id, user_id, event_type AS agent, event_type <> 'error' AS ok, value AS cost, ts, epoch(date_trunc('second', ts))::BIGINT AS at, event_id % 100 AS inp, event_id % 7 AS outp, event_id % 50 AS latency_ms FROM events)"


def _calls(spark, sf_dir):
    e, zero = _events(spark, sf_dir), F.lit(0).cast("long")
    return e.withColumns({
        "agent": F.col("event_type"), "ok": F.col("event_type") != "error", "cost": F.col("value"), "input": F.col("event_id") % 100, "output": F.col("event_id") % 7, "cache_read": zero, "cache_write": zero,
        "latency_ms": F.col("event_id") % 50, "model": F.concat(F.lit("m"), F.col("event_id") % 3), "error": F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id"))),
    })


@query(f"""WITH {_CALLS} SELECT count(*) AS calls, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, sum(inp)::BIGINT AS input, sum(outp)::BIGINT AS output, 0::BIGINT AS cache_read, 0::BIGINT AS cache_write,
 sum(latency_ms)::BIGINT AS latency_ms, sum(inp + outp)::BIGINT AS total_tokens, sum(cost::DECIMAL(18,6))::DOUBLE AS cost, round(avg(latency_ms) FILTER (ok), 3) AS avg_latency_ok FROM c""")
def usage_totals(spark, sf_dir):
    return portfolio.usage_totals(_calls(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))).drop("first_error", "first_model")


@query(f"WITH {_CALLS} SELECT agent, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, sum(cost::DECIMAL(18,6))::DOUBLE AS cost, round(avg(latency_ms), 3) AS avg_latency_all, arg_min('m' || (event_id % 3), {{'ts': ts, 'id': event_id}}) AS model FROM c GROUP BY 1")
def usage_by_agent(spark, sf_dir):
    return portfolio.usage_by_agent(_calls(spark, sf_dir).withColumn("at", F.struct("ts", "event_id")))


@query("SELECT event_id, round((event_id % 100 * 3.0::DOUBLE + event_id % 20 * 3.0::DOUBLE * 0.1::DOUBLE + event_id % 10 * 3.0::DOUBLE * 1.25::DOUBLE + event_id % 7 * 15.0::DOUBLE) / 1000000, 9) AS cost FROM events")
def call_costs(spark, sf_dir):
    """Cost of each call by the price formula."""
    i = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", F.round(portfolio.call_cost(i % 100, i % 7, i % 20, i % 10, F.lit(3.0), F.lit(15.0)), 9).alias("cost"))


@query("""WITH m AS (SELECT DISTINCT user_id, 'm' || (event_id % 3) AS m FROM events)
SELECT 'all' AS prices, bool_and(m IN ('m0', 'm1', 'm2')) AS cost_known FROM m UNION ALL SELECT 'two', bool_and(m IN ('m0', 'm1')) FROM m UNION ALL SELECT 'no calls', false""")
def cost_is_known(spark, sf_dir):
    """Known where every named model has a price and there is a call at all."""
    calls = _calls(spark, sf_dir)
    prices = lambda n: spark.createDataFrame([(f"m{i}", 1.0) for i in range(n)], "model string, price double")
    cases = {"all": (calls, 3), "two": (calls, 2), "no calls": (calls.filter("false"), 3)}
    out = [portfolio.cost_known(c, prices(n)).select(F.lit(name).alias("prices"), "cost_known") for name, (c, n) in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_CALLS} SELECT user_id AS run, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, sum(inp + outp)::BIGINT AS tokens, sum(cost::DECIMAL(18,6))::DOUBLE AS cost, round(avg(latency_ms) FILTER (ok), 3) AS avg_latency_ok FROM c GROUP BY 1")
def usage_by_run(spark, sf_dir):
    return portfolio.usage_by_run(_calls(spark, sf_dir), "user_id").withColumnRenamed("user_id", "run")


@query(f"""WITH {_CALLS}, k AS (SELECT user_id, agent, bool_or(ok) AS done FROM c GROUP BY 1, 2)
SELECT user_id AS run, coalesce(string_agg(agent, ',' ORDER BY agent) FILTER (done), '') AS done, coalesce(string_agg(agent, ',' ORDER BY agent) FILTER (NOT done), '') AS failed FROM k GROUP BY 1""")
def stage_sets(spark, sf_dir):
    sets = portfolio.stage_sets(_calls(spark, sf_dir), "user_id")
    return sets.select(F.col("user_id").alias("run"), F.array_join("done", ",").alias("done"), F.array_join("failed", ",").alias("failed"))


_OWN_PRICE = "CASE WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN {0} ELSE {1} END WHEN event_id % 3 = 1 THEN {2} {3} END"


@query(f"""WITH c AS (SELECT event_id, user_id, unnest(['manual', 'default', 'unknown']) AS known FROM events)
SELECT event_id, known, (CASE known WHEN 'manual' THEN 7.0 WHEN 'default' THEN {_OWN_PRICE.format("3.0", "9.0", "2.0", "ELSE 1.0")} ELSE {_OWN_PRICE.format("3.0", "9.0", "2.0", "")} END)::DOUBLE AS price_in,
 (CASE known WHEN 'manual' THEN 8.0 WHEN 'default' THEN {_OWN_PRICE.format("15.0", "45.0", "6.0", "ELSE 5.0")} ELSE {_OWN_PRICE.format("15.0", "45.0", "6.0", "")} END)::DOUBLE AS price_out FROM c""")
def price_fallback(spark, sf_dir):
    """The price by hand, else of the provider's model, else of the model, else the default, else
    none; two providers of one model name, and a price listed twice, leave one row a call."""
    calls = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), F.concat(F.lit("p"), F.col("user_id") % 2).alias("provider"))
    rows = [("p0", "m0", 3.0, 15.0), ("p0", "m0", 3.0, 15.0), ("p1", "m0", 9.0, 45.0), (None, "m1", 2.0, 6.0)]
    prices = spark.createDataFrame(rows, "provider string, model string, price_in double, price_out double")
    cases = {"manual": {"manual": (7.0, 8.0), "default": (1.0, 5.0)}, "default": {"default": (1.0, 5.0)}, "unknown": {}}
    out = [portfolio.priced(calls, prices, **how).select("event_id", F.lit(name).alias("known"), "price_in", "price_out") for name, how in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark, sf_dir):
    return portfolio.latest(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) = 1),
 s AS (SELECT o_custkey, min(o_orderkey) AS parent FROM orders GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey, l_returnflag AS mode, n, s.parent, CASE WHEN EXISTS (SELECT 1 FROM lineitem i WHERE i.l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'model' ELSE 'kural' END AS label FROM orders JOIN m ON m.l_orderkey = o_orderkey LEFT JOIN s USING (o_custkey)""")
def run_mode_backfill(spark, sf_dir):
    """Most frequent value per contract, the parent where there is exactly one, and a label by existence."""
    o, i = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    mode = portfolio.most_frequent(i, "l_orderkey", "l_returnflag").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("mode"), "n")
    rows = portfolio.attach_to_single(o.join(mode, "o_orderkey"), o, "o_custkey", "o_orderkey")
    returned = i.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return portfolio.exists_label(rows, returned, "o_orderkey", "model", "kural").select("o_orderkey", "mode", "n", "parent", "label")


@query("SELECT user_id, arg_min(event_type, {'ts': ts, 'e': event_type}) AS actor FROM events GROUP BY 1")
def uploader_backfill(spark, sf_dir):
    """The actor of the earliest matching audit entry."""
    return portfolio.earliest_actor(_events(spark, sf_dir), "user_id", "event_type", "ts")


@query("SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000) WHERE event_type = 'error' OR user_id % 10 = 1")
def audit_recent(spark, sf_dir):
    """Entries that touch something, among the newest 2000: the limit is the feature."""
    touches = (F.col("event_type") == "error") | (F.col("user_id") % 10 == 1)
    return portfolio.audit_of(_events(spark, sf_dir), 2000, [F.desc("ts"), F.desc("event_id")], touches).select("event_id", "user_id")


@query("""WITH r AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'contract' WHEN 'click' THEN 'report' ELSE event_type END AS entity_type, CASE event_type WHEN 'click' THEN event_id % 500 ELSE user_id END AS entity_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000)
SELECT event_id, entity_type, entity_id FROM r WHERE (entity_type = 'contract' AND entity_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 1)) OR (entity_type = 'report' AND entity_id IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 1)))""")
def audit_of_contracts(spark, sf_dir):
    """Entries about a customer, taken as a contract, or about its orders, taken as reports, among
    the newest 2000: the limit is the feature."""
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "contract").when(F.col("event_type") == "click", "report").otherwise(F.col("event_type"))
    audit = e.select("event_id", "ts", kind.alias("entity_type"), F.when(F.col("event_type") == "click", F.col("event_id") % 500).otherwise(F.col("user_id")).alias("entity_id"))
    contracts = _t(spark, sf_dir, "customer").filter("c_custkey % 5 = 1").select(F.col("c_custkey").alias("contract_id"))
    reports = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("contract_id"))
    return _long(portfolio.audit_of_contracts(audit, contracts, reports, 2000, [F.desc("ts"), F.desc("event_id")]).select("event_id", "entity_type", "entity_id"))


@query("""SELECT o_orderkey, (SELECT string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders""")
def audit_fan_in(spark, sf_dir):
    """One array a side, so that sides never multiply each other."""
    i = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    rows = portfolio.fan_in(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", xs=i)
    return rows.select("o_orderkey", F.array_join(F.transform("xs", lambda x: F.concat(x["l_linenumber"], F.lit(":"), x["l_returnflag"])), ",").alias("lines"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def resume_remaining(spark, sf_dir):
    done = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _long(portfolio.remaining(_t(spark, sf_dir, "lineitem"), done, ["l_orderkey"]).select("l_orderkey", "l_linenumber"))


@query("SELECT l_orderkey, round(least(100.0, count(*) FILTER (l_linestatus = 'F') * 100.0::DOUBLE / count(*)), 1) AS percent FROM lineitem GROUP BY 1")
def progress(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "F", "DONE").otherwise("PENDING").alias("status"), F.lit(0).alias("items_done"), F.lit(0).alias("items_total"))
    return portfolio.progress(c, "l_orderkey")


@query(f"""WITH {_CALLS}, w AS (SELECT user_id, row_number() OVER o AS seq, coalesce(sum(cost::DECIMAL(18,6)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, min(seq) FILTER (seq - 1 >= 20 OR spent >= 500) AS cutoff, count(*) AS calls FROM w GROUP BY 1""")
def budget_cutoff(spark, sf_dir):
    """The first call of each run that a cap would have refused."""
    return portfolio.budget_cutoff(_calls(spark, sf_dir), "user_id", ["ts", "event_id"], {"calls": 20, "cost": 500})


@query(f"""WITH {_CALLS}, i AS (SELECT user_id, ok, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c), r AS (SELECT user_id, island, count(*) AS run FROM i WHERE NOT ok GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (run >= 2) AS trips, max(run) AS longest FROM r GROUP BY 1""")
def breaker_trips(spark, sf_dir):
    return portfolio.breaker_trips(_calls(spark, sf_dir), "user_id", ["ts", "event_id"], 2)


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND event_id % 11 <> 0 AND (user_id % 4 <> 0 OR epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts)) > 604800)")
def orphan_runs(spark, sf_dir):
    """Unfinished runs of another owner or without a fresh heartbeat."""
    runs = _events(spark, sf_dir).select("event_id", F.when(F.col("event_type").isin("view", "click"), "RUNNING").otherwise("DONE").alias("status"), (F.col("event_id") % 11 == 0).alias("cancelled"), (F.col("user_id") % 4).cast("string").alias("owner_id"), F.col("ts").alias("heartbeat_at"))
    return portfolio.orphans(runs, "0", F.lit("2024-02-01").cast("timestamp"), 604_800).select("event_id")


@query("SELECT o_orderkey, epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate) > 365 * 86400 AND o_orderstatus <> 'O' AS expired FROM orders")
def retention_mark(spark, sf_dir):
    return portfolio.retention_mark(_t(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp")), "d", F.lit("1998-08-02").cast("timestamp"), 365, F.col("o_orderstatus") == "O").select("o_orderkey", "expired")


@query()
def throttle_replay(spark, sf_dir):
    """Sliding-window throttle: five accepted requests an hour and key; rejected ones are free."""
    r = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "at", (F.col("event_type") != "error").alias("ok"))
    return throttle.replay(r, 5, 3600)


@query()
def login_throttle(spark, sf_dir):
    """Eight failures in five minutes lock a key; a success clears it."""
    r = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "at", (F.col("event_type") != "error").alias("ok"))
    return throttle.replay(r, 8, 300, login=True)


@query("""SELECT time_bucket(INTERVAL 1 day, ts) AS "start", time_bucket(INTERVAL 1 day, ts) + INTERVAL 1 day AS "end", event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    """Daily usage windows (an extension)."""
    out = throttle.windowed_usage(_events(spark, sf_dir), "1 day")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minute THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 minute AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    """Sessions with a gap of thirty minutes (an extension)."""
    out = throttle.session_usage(_events(spark, sf_dir), "30 minutes")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


# --- versions -------------------------------------------------------------------------------


def _turns(spark, sf_dir):
    """Consecutive assistant turns of a conversation as two versions."""
    c = _t(spark, sf_dir, "conversations").filter("role = 'assistant'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("old"), F.lead("text").over(w).alias("new")).filter("new is not null")


_TURNS = "v AS (SELECT conv_id, turn, coalesce(text, '') AS old, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations WHERE role = 'assistant' QUALIFY new IS NOT NULL)"
_KEYS = f"list_distinct(regexp_extract_all({FOLD}, '[0-9A-Za-zÇĞİÖŞÜçğıöşü]+'))"


@query(f"""WITH {_TURNS}, k AS (SELECT conv_id, turn, {_KEYS.format('old')} AS a, {_KEYS.format('new')} AS b FROM v)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 4) AS jaccard FROM k""")
def token_jaccard_pairs(spark, sf_dir):
    """Overlap of two versions' word keys, the cheap look before alignment."""
    a, b = (F.array_distinct(compare.match_key(F.col(c))) for c in ("old", "new"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", a.alias("a"), b.alias("b"))
    share = F.size(F.array_intersect("a", "b")) / F.nullif(F.size(F.array_union("a", "b")), F.lit(0))
    return rows.select("conv_id", "turn", F.round(share, 4).alias("jaccard"))


@query(rf"""WITH {_TURNS} SELECT conv_id, turn, len(list_filter(regexp_extract_all(new, '\d+(?:[.,]\d+)*'), lambda x: NOT contains(old, x))) = 0 AS anchored FROM v""")
def anchor_check(spark, sf_dir):
    """Whether every number of an answer occurs in the one before it."""
    return _turns(spark, sf_dir).select("conv_id", "turn", compare.anchors_hold(F.col("new"), F.col("old"), F.lit(None).cast("string")).alias("anchored"))


def _changes(spark, sf_dir):
    v = _turns(spark, sf_dir).withColumn("comparison_id", F.concat_ws("-", "conv_id", "turn"))
    sides = []
    for c in ("old", "new"):
        parts = F.filter(F.split(F.col(c), r"(?<=[.!?])\s+"), lambda x: x != "")
        sides.append(v.select("comparison_id", F.posexplode(parts).alias("order_index", "text")).withColumns({"number": F.lit(""), "heading": F.lit(""), "is_gap": F.lit(False)}))
    return compare.align(*sides)


@query()
def version_changes(spark, sf_dir):
    """Every sentence of both versions once: same, moved, changed, added or removed."""
    return _changes(spark, sf_dir).select("comparison_id", "order_index", "change_type", "i", "j", "similarity", "significant")


@query()
def diff_materiality(spark, sf_dir):
    c = _changes(spark, sf_dir)
    return c.select("comparison_id", "order_index", compare.materiality(F.col("change_type"), F.col("significant"), F.col("word_diff")).alias("materiality"), compare.diff_summary(F.col("word_diff")).alias("summary"))


# --- flagship --------------------------------------------------------------------------------


@query(f"""WITH {_SCORE}, n AS (SELECT doc_id, count(*) AS n_lines FROM f GROUP BY 1), x AS (SELECT doc_id, count(*) AS n_hits FROM sc GROUP BY 1),
 m(code, w) AS (VALUES ('LICENSING', 4), ('SECRETS', 5)), p AS (SELECT doc_id, count(*) AS n_missing, sum(CASE code WHEN 'LICENSING' THEN 12.0 ELSE 3.0 END)::DOUBLE AS miss FROM documents, m WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.doc_id = documents.doc_id AND sc.code = m.code) GROUP BY 1),
 rr AS (SELECT f.doc_id, count(*) AS red FROM f JOIN sc ON f.doc_id = sc.doc_id AND f.order_index = sc.order_index JOIN pt ON pt.code = sc.code WHERE regexp_matches({_LOW.format('line')}, p) GROUP BY 1),
 z AS (SELECT d.doc_id, n_lines, coalesce(n_hits, 0) AS n_hits, coalesce(n_missing, 0) AS n_missing, coalesce(red, 0) AS red, coalesce(miss, 0)::DOUBLE + 20.0::DOUBLE * coalesce(red, 0) AS penalty FROM documents d JOIN n USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN rr USING (doc_id)),
 s2 AS (SELECT *, round(greatest(0.0, 100.0::DOUBLE - 100.0::DOUBLE * penalty / (penalty + 180.0::DOUBLE)), 1) AS score FROM z)
SELECT doc_id, n_lines, n_hits, n_missing, penalty, score, CASE WHEN red > 0 OR score < 60 THEN 'KIRMIZI' WHEN score < 80 THEN 'SARI' ELSE 'YESIL' END AS band, quality::BIGINT AS quality FROM s2 LEFT JOIN labels USING (doc_id)""")
def doc_risk_scorecard(spark, sf_dir):
    """Lines, type hits, missing types, penalty, score and band of each document, with its label."""
    clauses = _clauses(spark, sf_dir)
    classified = stored(classify.classify(clauses, TYPES, "doc_id").filter(F.size("codes") > 0), "scorecard-classified")
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    codes = classified.select("doc_id", F.explode("codes.code").alias("code"))
    docs = _docs(spark, sf_dir).withColumn("contract_type", F.lit("SAAS"))
    missing = scoring.gap_candidates(docs.select("doc_id", "contract_type"), to_frame(spark, TYPES), codes.distinct(), "doc_id")
    miss = missing.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_missing"), F.sum(scoring.severity_points(F.col("severity_if_missing")) * F.col("weight")).alias("miss"))
    red = count(rules.positive_red_lines(classified, TYPES, "doc_id"), "red")
    rows = count(clauses, "n_lines").join(count(codes, "n_hits"), "doc_id", "left").join(miss, "doc_id", "left").join(red, "doc_id", "left").fillna(0)
    rows = rows.withColumn("penalty", F.col("miss") + 20.0 * F.col("red"))
    rows = rows.withColumn("score", F.round(F.greatest(F.lit(0.0), 100.0 - 100.0 * F.col("penalty") / (F.col("penalty") + scoring.HALF)), 1))
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return rows.join(labels, "doc_id", "left").select("doc_id", "n_lines", "n_hits", "n_missing", "penalty", "score", scoring.band(F.col("score"), F.col("red") > 0).alias("band"), "quality")


@query()
def contract_analysis(spark, sf_dir):
    """The whole analysis, documents taken as contracts: clauses, findings, what grounding
    dropped, score and band of each."""
    contracts = dealt(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("contract_id"), F.col("text").alias("raw_text")))
    found = analysis.analyse(contracts, TYPES)
    count = lambda df, name: df.groupBy("contract_id").agg(F.count(F.lit(1)).alias(name))
    rows = found.scores
    for df, name in ((found.clauses, "n_clauses"), (found.findings, "n_findings"), (found.dropped, "n_dropped")):
        rows = rows.join(count(df, name), "contract_id", "left").fillna(0, [name])
    return rows.select("contract_id", "n_clauses", "n_findings", "n_dropped", "total", "red_lines", "score", "band")
