"""Results out: idempotent tables, JSON and HTML reports, redline operations, audit entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES, severity_rank


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Writes ``rows`` partitioned by ``by`` over the partitions they have and no other: a stage
    that runs again replaces its own output."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and what of ``old`` it does not replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append_audit(entries: DataFrame, path: str) -> None:
    """Appends audit entries, in partitions by day."""
    entries.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def report_payload(contracts: DataFrame, findings: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, payload): the whole report of a contract as JSON, findings gravest first."""
    cols = [c for c in findings.columns if c != key]
    rank = F.when(severity_rank(F.col("severity")).isNotNull(), -severity_rank(F.col("severity"))).otherwise(1)
    items = findings.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r_"), (-F.col("confidence")).alias("c_"), F.struct(*cols).alias("f")))), lambda x: x["f"]).alias("findings"))
    rows = contracts.join(items, key, "left")
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("payload"))


def write_json_reports(payloads: DataFrame, path: str) -> None:
    payloads.write.mode("overwrite").json(path)


def escaped(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_report(contracts: DataFrame, findings: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, html): a summary line and one section a severity, all text escaped. Rendered by
    Spark, one row a contract; nothing passes through the driver."""
    item = F.concat(F.lit("<li><b>"), escaped(F.col("title")), F.lit("</b> <q>"), escaped(F.col("quote")), F.lit("</q></li>"))
    rank = severity_rank(F.col("severity"))
    sections = findings.groupBy(key, "severity", rank.alias("rank")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), item.alias("html")))), lambda x: x["html"]), "").alias("items"), F.count(F.lit(1)).alias("n"))
    section = F.concat(F.lit("<h2>"), F.col("severity"), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h2><ul>"), F.col("items"), F.lit("</ul>"))
    body = sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), section.alias("html")))), lambda x: x["html"]), "").alias("body"))
    head = F.concat(F.lit("<h1>"), escaped(F.col(key)), F.lit("</h1><p>"), escaped(F.col("score")), F.lit(" "), escaped(F.col("band")), F.lit("</p>"))
    return contracts.join(body, key, "left").select(key, F.concat(F.lit("<!doctype html><meta charset=utf-8>"), head, F.coalesce("body", F.lit("<p>-</p>"))).alias("html"))


def redline_operations(findings: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, seq, operations): edits for findings with a proposed text, by severity and clause
    number as text. A quote that is evidence is deleted and replaced, context only added to."""
    rows = findings.filter((F.coalesce("proposed_text", F.lit("")) != "") & (F.col("finding_type") != "INFO"))
    op = lambda kind, text: F.struct(F.lit(kind).alias("op"), text.alias("text"))
    insert, delete = op("insert", F.col("proposed_text")), op("delete", F.col("quote"))
    ops = F.when(F.col("quote_is_evidence") & (F.coalesce("quote", F.lit("")) != ""), F.array(delete, insert)).otherwise(F.array(insert))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(severity_rank(F.col("severity"))), "clause_number", "title"))
    return rows.select(key, order.alias("seq"), "clause_number", "severity", ops.alias("operations"))


def manifest(paths: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Report manifest rows (contract_id, fmt, path, size), newer ones replacing older."""
    return paths if previous is None else upsert(previous, paths, ["contract_id", "fmt"])


def severity_summary(findings: DataFrame, key: str = "contract_id") -> DataFrame:
    return findings.groupBy(key).pivot("severity", list(SEVERITIES)).count().fillna(0)
