"""The analysis of contracts end to end, as an ordered list of resumable stages.

No stage collects. Each writes its table once, so every later branch reads it instead of
deriving it anew, and a run that was cut off goes on where it stopped. Verdicts on gaps
may come as a table; a model may add findings through an enricher, and without one, or
where it refuses, the rules decide alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, enrich, meta, normalize, rules, scoring, segment
from ..sources.catalog import ClauseType, to_frame
from ..storage import shared_path
from .stages import KEY, Run, Stage


@dataclass
class Analysis:
    normalized: DataFrame
    clauses: DataFrame
    classified: DataFrame
    meta: DataFrame
    findings: DataFrame
    dropped: DataFrame
    scores: DataFrame
    replies: DataFrame
    run: Run


def prepare(contracts: DataFrame) -> DataFrame:
    """Fills the flags' defaults and normalises the text."""
    defaults = {"contract_type": F.lit("SAAS"), "involves_personal_data": F.lit(True), "is_outsourcing": F.lit(False)}
    for name, value in defaults.items():
        contracts = contracts.withColumn(name, F.coalesce(name, value) if name in contracts.columns else value)
    return contracts.select(KEY, *defaults, normalize.normalize(F.coalesce("raw_text", F.lit(""))).alias("text"))


def deterministic(docs: DataFrame) -> DataFrame:
    """Document-level findings: annexes referred to but absent, drafting defects."""
    annex = docs.filter(F.col("text").rlike(rules.ANNEXED)).select(KEY, F.explode(rules.missing_annexes(F.col("text"))).alias("n"))
    annex = annex.select(KEY, F.lit("ORTA").alias("severity"), F.concat(F.lit("EK-"), F.col("n")).alias("title"), F.lit("").alias("quote"), F.lit("CROSS_REF_ERROR").alias("finding_type"), F.lit(0.9).alias("confidence"))
    defects = rules.drafting_defects(docs).select(KEY, "severity", F.col("kind").alias("title"), "quote", F.lit("DRAFTING_DEFECT").alias("finding_type"), F.lit(0.95).alias("confidence"))
    return annex.unionByName(defects).withColumns({"code": F.lit("ENTIRE_AGREEMENT"), "detected_by": F.lit("RULE_DET")})


def rule_hits(classified: DataFrame, types: list[ClauseType]) -> DataFrame:
    """Red lines and absences of classified clauses, in the order of ``first seen``: by clause, then
    by kind of rule, then by the catalogue's order."""
    order = rules.rule_frame(classified.sparkSession, types).select("code", "rule_id", "rule_order")
    hits = [
        rules.rule_findings(found(classified, types, KEY, "buyers"), kind).drop("start", "end").withColumn("kind_", F.lit(at))
        for at, (found, kind) in enumerate([(rules.positive_red_lines, "PATTERN"), (rules.absent_red_lines, "ABSENCE")])
    ]
    return hits[0].unionByName(hits[1]).join(F.broadcast(order), ["code", "rule_id"], "left")


def clause_findings(classified: DataFrame, hits: DataFrame, replies: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One finding a clause, code and kind: a model's where it judged the clause, else the rules'."""
    vague = rules.ambiguous_findings(classified).withColumn("kind_", F.lit(2))
    ruled = hits.drop("rule_id").unionByName(vague, allowMissingColumns=True)
    ruled = ruled.join(enrich.answered(replies), [KEY, "order_index", "code"], "left_anti").withColumn("lens", F.lit(""))
    told = enrich.model_findings(replies, catalogue).withColumns({"kind_": F.lit(3), "rule_order": F.col("at_")}).drop("at_")
    found = ruled.unionByName(told, allowMissingColumns=True)
    found = found.join(classified.select(KEY, "order_index", F.col("number").alias("clause_number")), [KEY, "order_index"], "left")
    seq = F.struct("order_index", "kind_", F.coalesce("rule_order", F.lit(0)), "code", "lens", "title")
    return rules.dedupe_findings(found.withColumn("seq", seq)).drop("seq", "kind_", "rule_order")


def stage_list(types: list[ClauseType], catalogue: DataFrame, verdicts: DataFrame | None = None, enricher: Callable = enrich.refuse, parts: int = 1) -> list[Stage]:
    """The stages in order. The model's stage works on clauses, in ``parts`` batches, so that what it
    has answered is not asked again."""

    def clauses(t, todo):
        buyers = t["meta"].select(KEY, meta.split_terms(F.col("terms"))["buyers"].alias("buyers"))
        kinds = t["normalized"].select(KEY, "contract_type")
        return segment.clauses(t["normalized"]).join(buyers, KEY, "left").join(kinds, KEY)

    def classified(t, todo):
        return classify.classify(t["clauses"], types, buyers="buyers", contract_type="contract_type")

    def item(df):
        return F.concat_ws(":", F.col("order_index").cast("string"), "number")

    def asked(t, todo):
        weighed = scoring.clauses_for_model(t["classified"], catalogue, KEY, 40).select(KEY, "order_index")
        return t["classified"].join(weighed, [KEY, "order_index"]).select(KEY, item(t).alias("item"))

    def replies(t, todo):
        mine = t["classified"]
        if enricher is enrich.refuse:
            return enrich.refused(mine.withColumn("item", item(t)).join(todo.select(KEY, "item"), [KEY, "item"], "left_semi"), catalogue).join(mine.select(KEY, "order_index", item(t).alias("item")), [KEY, "order_index"])
        prompts = enrich.prompt_rows(mine, types, catalogue, t["hits"])
        numbered = prompts.join(mine.select(KEY, "order_index", item(t).alias("item")), [KEY, "order_index"]).join(todo.select(KEY, "item"), [KEY, "item"], "left_semi")
        back = numbered.select(KEY, "order_index", "item").distinct()
        return enrich.answers(numbered, enricher).join(back, [KEY, "order_index"])

    def gaps(t, todo):
        detected = t["classified"].select(KEY, F.explode("codes.code").alias("code")).distinct()
        docs = t["normalized"].select(KEY, "text", "contract_type")
        return scoring.detect_gaps(docs, catalogue, detected, verdicts=verdicts).drop("status", "hits", "verified")

    def judged(t, todo):
        found = clause_findings(t["classified"], t["hits"], t["replies"], catalogue)
        everything = found.unionByName(t["defects"], allowMissingColumns=True).unionByName(t["gaps"], allowMissingColumns=True)
        return scoring.ground(everything, t["clauses"], t["normalized"])

    return [
        Stage("normalized", lambda t, todo: prepare(t["contracts"].repartition(KEY))),
        Stage("meta", lambda t, todo: meta.extract_meta(t["normalized"])),
        Stage("clauses", clauses), Stage("classified", classified), Stage("hits", lambda t, todo: rule_hits(t["classified"], types)),
        Stage("defects", lambda t, todo: deterministic(t["normalized"])), Stage("replies", replies, asked, parts), Stage("gaps", gaps), Stage("judged", judged),
    ]


def analyse(contracts: DataFrame, types: list[ClauseType], verdicts: DataFrame | None = None, enricher: Callable = enrich.refuse, root: str | None = None, parts: int = 1) -> Analysis:
    """``contracts`` (contract_id, raw_text, optional type and flags) to scored findings. With a
    ``root`` of an earlier run, what it finished for unchanged contracts is not done again."""
    spark = contracts.sparkSession
    catalogue = to_frame(spark, types)
    given = [c for c in contracts.columns if c != KEY]
    marked = contracts.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*given)).cast("binary"), 256))
    run = Run(spark, root or shared_path(spark, "analysis"), stage_list(types, catalogue, verdicts, enricher, parts), contracts.schema[KEY].dataType.simpleString())
    t = run.resume(marked)
    docs, judged = t["normalized"], t["judged"]
    flags = docs.select(KEY, "involves_personal_data", "is_outsourcing")
    kept = judged.filter("kept").drop("kept", "reason").join(flags, KEY).join(F.broadcast(catalogue.select("code", "category", "weight")), "code", "left")
    context = scoring.context_multiplier(F.col("category"), F.col("involves_personal_data"), F.col("is_outsourcing"))
    kept = kept.withColumn("score", scoring.finding_score(F.col("severity"), F.col("weight"), context, F.col("confidence"))).drop("involves_personal_data", "is_outsourcing")
    return Analysis(docs, t["clauses"], t["classified"], t["meta"], kept, judged.filter("not kept").drop("kept"), scoring.contract_scores(docs, kept), t["replies"], run)
