"""Findings of a language model: prompts as rows, a pluggable enricher, replies made to fit.

The enricher is any function from a list of prompts to a list of replies; the library
calls none itself and by default refuses. Where it refuses, fails or replies with what
is no finding list, the rules' findings stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import json_text
from ..sources.catalog import ClauseType
from . import rules, scoring

#: Most characters of a clause in a prompt, of a title and of a rationale.
CLAUSE_CHARS, TITLE_CHARS, RATIONALE_CHARS = 12_000, 480, 1_500
CHUNK = 16
REPLY = "findings array<struct<finding_type string, severity string, title string, rationale string, quote string, legal_basis array<string>, proposed_text string, negotiation_note string, confidence double>>, injection_attempt boolean"
ANSWER = ("reply", "error", "model", "input_tokens", "output_tokens", "latency_ms")


def checklist(spark: SparkSession, types: list[ClauseType]) -> DataFrame:
    """(code, lines): red lines of each type in order, as a prompt lists them. Small by nature."""
    rows = [(t.code, [(r.id, r.severity, r.text) for r in t.red_lines]) for t in types]
    return spark.createDataFrame(rows, "code string, lines array<struct<rule_id string, severity string, text string>>")


def _asked(rows: DataFrame, catalogue: DataFrame, key: str, most: int, lenses: bool) -> DataFrame:
    """(key, order_index, code, lens, ...): the heaviest ``most`` clauses of a contract, each code of
    them, each from a general view first and then from the lenses of the type."""
    picked = scoring.clauses_for_model(rows, catalogue, key, most).select(key, "order_index")
    wide = rows.join(picked, [key, "order_index"]).withColumn("code", F.explode("codes.code")).join(F.broadcast(catalogue.drop("catalog_order", "keywords", "applies_to")), "code")
    views = F.concat(F.array(F.lit("")), scoring.lenses(F.col("category"), F.col("weight")) if lenses else F.array().cast("array<string>"))
    return wide.withColumn("lens", F.explode(views))


def prompt_rows(classified: DataFrame, types: list[ClauseType], catalogue: DataFrame, hits: DataFrame | None = None, key: str = "contract_id", most: int = 40, lenses: bool = True) -> DataFrame:
    """(key, order_index, code, lens, effort, prompt): what a model would be asked. ``classified`` may
    carry ``number`` and ``parties`` (struct<buyers, suppliers>); ``hits`` (key, order_index, code, rule_id)
    marks the lines of the checklist that rules found violated.

    The prompt is one projection: the view, the parties, the clause, the standard it is
    held against, the checklist, vague phrases, and the bases that may be cited.
    """
    rows = _asked(classified, catalogue, key, most, lenses).join(F.broadcast(checklist(classified.sparkSession, types)), "code")
    if hits is None:
        rows = rows.withColumn("hit_", F.array().cast("array<string>"))
    else:
        found = hits.groupBy(key, "order_index", "code").agg(F.collect_set("rule_id").alias("hit_"))
        rows = rows.join(found, [key, "order_index", "code"], "left").withColumn("hit_", F.coalesce("hit_", F.array().cast("array<string>")))
    has = lambda c: c in classified.columns
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    line = lambda label, c: F.concat(F.lit(label), c)  # noqa: E731  null where there is nothing to say
    listed = F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x["severity"], F.lit("] "), x["text"], F.when(F.array_contains("hit_", x["rule_id"]), F.lit(" (kural eşleşti)")).otherwise("")))
    vague = F.array_join(F.array_sort(F.array_distinct(F.transform(rules.ambiguous(F.col("text"), F.col("code")), lambda x: x["phrase"]))), ", ")
    names = lambda side: F.array_join(F.col("parties")[side], ", ") if has("parties") else F.lit(None).cast("string")
    parts = [
        line("Bakış: ", some(F.col("lens"))), line("Alıcı: ", some(names("buyers"))), line("Tedarikçi: ", some(names("suppliers"))),
        F.concat_ws(" ", F.lit("Madde"), some(F.col("number").cast("string")) if has("number") else F.lit(None).cast("string"), some(F.col("heading"))),
        F.concat(F.lit("Tip: "), F.col("code"), F.lit(", "), F.col("name"), F.lit(", ağırlık "), F.col("weight").cast("string"), F.lit(", "), F.col("obligation")),
        F.concat(F.lit("<madde>\n"), F.substring("text", 1, CLAUSE_CHARS), F.lit("\n</madde>")),
        line("Standart: ", some(F.col("ideal_text"))), line("Denetim listesi:\n", some(F.array_join(listed, "\n"))), line("Ölçülemez ifadeler: ", some(vague)),
        line("Sade anlatım: ", some(F.col("plain"))), line("Dayanaklar: ", some(F.array_join("legal_basis", "; "))),
    ]
    return rows.select(key, "order_index", "code", "lens", scoring.effort(F.col("weight")).alias("effort"), F.concat_ws("\n", *parts).alias("prompt"))


def refuse(prompts: list[dict]) -> list[dict]:
    """The enricher of a library without a model."""
    return [{"error": "no model"} for _ in prompts]


def answers(prompts: DataFrame, enricher: Callable[[list[dict]], list[dict]] = refuse, key: str = "contract_id") -> DataFrame:
    """``prompts`` without their text, with reply, error, model, tokens and latency. The enricher gets
    some prompts at a time; what it raises is the error of these prompts, not of the job."""
    kept = [key, "order_index", "code", "lens"]
    types = {"input_tokens": "long", "output_tokens": "long", "latency_ms": "long"}
    schema = ", ".join([*(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {types.get(c, 'string')}" for c in ANSWER)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                try:
                    found = enricher(part.to_dict("records"))
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} replies to {len(part)} prompts")
                except Exception as e:  # one prompt must not end the analysis
                    found = [{"error": f"{type(e).__name__}: {e}"[:500]}] * len(part)
                out = part[kept].reset_index(drop=True)
                for c in ANSWER:
                    values = [x.get(c) for x in found]
                    out[c] = pd.array(values, dtype="Int64") if c in types else values
                yield out

    return prompts.select(*kept, "effort", "prompt").mapInPandas(run, schema)


def refused(classified: DataFrame, catalogue: DataFrame, key: str = "contract_id", most: int = 40) -> DataFrame:
    """What ``answers`` gives where there is no model: a refusal for each clause and code that one would
    have been asked about, without building a prompt."""
    rows = _asked(classified, catalogue, key, most, False)
    null = lambda c: F.lit(None).cast("long" if c in ("input_tokens", "output_tokens", "latency_ms") else "string").alias(c)
    return rows.select(key, "order_index", "code", "lens", *[F.lit("no model").alias(c) if c == "error" else null(c) for c in ANSWER])


def parsed(replies: DataFrame) -> DataFrame:
    """``replies`` with ``body``, null where the reply failed or holds no finding list."""
    body = F.from_json(json_text(F.col("reply")), REPLY)
    return replies.withColumn("body", F.when(F.col("error").isNull() & body["findings"].isNotNull(), body))


def answered(replies: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, order_index, code) that a model judged from the general view: there the rules give way."""
    return parsed(replies).filter("lens = '' and body is not null").select(key, "order_index", "code").distinct()


def model_findings(replies: DataFrame, catalogue: DataFrame, key: str = "contract_id") -> DataFrame:
    """Findings in good replies: values outside the closed sets made to fit, bases that the catalogue
    does not list left out, empty proposals filled from the catalogue. A reply that saw an
    instruction in the text adds a finding of its own."""
    rows = parsed(replies).filter("body is not null").join(F.broadcast(catalogue.select("code", F.col("legal_basis").alias("listed_"), "ideal_text", "argument")), "code")
    each = rows.select(key, "order_index", "code", "lens", "listed_", "ideal_text", "argument", F.posexplode("body.findings").alias("at_", "f"))
    text = lambda c, most=None: F.substring(F.coalesce(c, F.lit("")), 1, most) if most else F.trim(F.coalesce(c, F.lit("")))
    or_else = lambda c, other: F.coalesce(F.nullif(text(c), F.lit("")), other)
    found = each.select(
        key, "order_index", "code", "lens", "at_", F.coalesce("f.finding_type", F.lit("WEAK")).alias("finding_type"), F.coalesce("f.severity", F.lit("ORTA")).alias("severity"),
        text(F.col("f.title"), TITLE_CHARS).alias("title"), text(F.col("f.rationale"), RATIONALE_CHARS).alias("rationale"), text(F.col("f.quote")).alias("quote"),
        rules.allowed_basis(F.coalesce("f.legal_basis", F.array().cast("array<string>")), F.col("listed_")).alias("legal_basis"), or_else(F.col("f.proposed_text"), F.col("ideal_text")).alias("proposed_text"),
        or_else(F.col("f.negotiation_note"), F.col("argument")).alias("negotiation_note"), F.coalesce(F.nullif("f.confidence", F.lit(0.0)), F.lit(0.8)).alias("confidence"),
    )
    told = rows.filter("body.injection_attempt").select(key, "order_index", "code", "lens", F.lit(-1).alias("at_"), F.lit("INFO").alias("finding_type"), F.lit("YUKSEK").alias("severity"), F.lit("Metinde modele yönelik talimat").alias("title"), F.lit("").alias("rationale"), F.lit("").alias("quote"), F.lit(0.6).alias("confidence"))
    return rules.coerced(found).unionByName(told, allowMissingColumns=True).withColumns({"quote_is_evidence": F.lit(True), "detected_by": F.lit("LLM")})


def calls(replies: DataFrame, at: Column | None = None, key: str = "contract_id") -> DataFrame:
    """The call log of replies, as the usage queries read it: agent, ok, tokens, latency, error."""
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias
    agent = F.when(F.col("lens") == "", "RiskAnalyst").otherwise(F.concat(F.lit("RiskAnalyst/"), F.col("lens")))
    seq = F.row_number().over(Window.partitionBy(key).orderBy("order_index", "code", "lens"))
    return replies.select(key, agent.alias("agent"), F.col("error").isNull().alias("ok"), "model", n("input_tokens")("input"), n("output_tokens")("output"), n("latency_ms")("latency_ms"), "error", (at if at is not None else seq).alias("at"))
