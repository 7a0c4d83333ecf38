"""The report of an analysis: one dataset a section, and the sections as one page a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import classify, enrich, scoring
from ..schemas import severity_rank
from ..sources.sinks import escaped
from .analysis import Analysis
from .stages import KEY

ACTIONS, BAR = 5, 20
TITLES = {"actions": "Öncelikli işler", "findings": "Bulgular", "gaps": "Eksik maddeler", "unreviewed": "İncelenmeyen maddeler", "glossary": "Sözlük", "usage": "Model kullanımı"}


def sections(found: Analysis, catalogue: DataFrame) -> dict[str, DataFrame]:
    """Rows by section, each with the contract and ``seq``, its place in the section: the gravest
    findings; all findings; missing types; clauses that no type fits, which a report must show;
    plain words for the types found; model calls by agent with a bar of their tokens."""
    catalogue = catalogue.select("code", "name", "plain")
    findings = found.findings.join(F.broadcast(catalogue), "code", "left")
    gravest = [F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), "clause_number", "code", "title"]
    seq = lambda rows, *order: rows.withColumn("seq", F.row_number().over(Window.partitionBy(KEY).orderBy(*order)))
    shown = [KEY, "seq", "severity", "finding_type", "code", "clause_number", "title", "quote", "confidence", "detected_by"]
    missing = F.col("finding_type") == "MISSING"
    words = findings.filter(F.coalesce("plain", F.lit("")) != "").select(KEY, "code", "name", "plain").distinct()
    calls = enrich.calls(found.replies)
    tokens = F.sum(F.col("input") + F.col("output"))
    usage = calls.groupBy(KEY, "agent").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), tokens.alias("tokens"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("first_error"))
    most = F.max("tokens").over(Window.partitionBy(KEY))
    usage = usage.withColumn("bar", F.when(most > 0, F.ceil(BAR * F.col("tokens") / most)).otherwise(0))
    ordered = seq(findings, *gravest)
    return {
        "actions": seq(scoring.top_per_group(findings.filter(~F.col("severity").isin("BILGI")), [KEY], gravest, ACTIONS), "rank").select(*shown), "findings": ordered.filter(~missing).select(*shown),
        "gaps": seq(findings.filter(missing), *gravest).select(KEY, "seq", "severity", "code", "name", "confidence"),
        "unreviewed": seq(classify.unclassified(found.classified), "order_index").select(KEY, "seq", "number", "heading"),
        "glossary": seq(words, "name", "code").select(KEY, "seq", "code", "name", "plain"), "usage": seq(usage, F.desc("tokens"), "agent").select(KEY, "seq", "agent", "calls", "failed", "tokens", "first_error", "bar"),
    }


def write_sections(parts: dict[str, DataFrame], root: str) -> None:
    """A dataset a section, for any tool that reads Parquet."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}")


def _line(name: str) -> Column:
    e = escaped
    if name in ("actions", "findings"):
        return F.concat(F.lit("<b>"), e(F.col("severity")), F.lit("</b> "), e(F.col("title")), F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit(" <q>"), e(F.col("quote")), F.lit("</q>"))).otherwise(""))
    if name == "gaps":
        return F.concat(F.lit("<b>"), e(F.col("severity")), F.lit("</b> "), e(F.coalesce("name", "code")))
    if name == "unreviewed":
        return F.concat_ws(" ", e(F.col("number")), e(F.col("heading")))
    if name == "glossary":
        return F.concat(F.lit("<b>"), e(F.col("name")), F.lit("</b>: "), e(F.col("plain")))
    return F.concat(e(F.col("agent")), F.lit(": "), F.col("calls").cast("string"), F.lit(" / "), F.col("tokens").cast("string"), F.lit(" "), F.repeat(F.lit("█"), F.col("bar").cast("int")), F.when(F.col("first_error").isNotNull(), F.concat(F.lit(" "), e(F.col("first_error")))).otherwise(""))


def pages(found: Analysis, parts: dict[str, DataFrame]) -> DataFrame:
    """(contract_id, html): score, band and every section that has rows, all text escaped."""
    rows = found.scores
    for name, part in parts.items():
        items = part.select(KEY, "seq", F.concat(F.lit("<li>"), _line(name), F.lit("</li>")).alias("li")).groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "li"))), lambda x: x["li"]), "").alias(f"html_{name}"))
        rows = rows.join(items, KEY, "left")
    blocks = [F.concat(F.lit(f"<h2>{title}</h2><ul>"), F.col(f"html_{name}"), F.lit("</ul>")) for name, title in TITLES.items()]
    head = F.concat(F.lit("<!doctype html><meta charset=utf-8><h1>"), escaped(F.col(KEY)), F.lit("</h1><p>"), escaped(F.col("score")), F.lit(" "), escaped(F.col("band")), F.lit("</p>"))
    return rows.select(KEY, F.concat_ws("", head, *blocks).alias("html"))
