"""Gaps, grounding, rebuttal, scores and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_quote, fold, fold_text, let, quote_span
from ..schemas import SEVERITIES, severity_points, severity_rank
from ..storage import stored

HALF = 180.0
#: Fixed value: shorter quotes are no evidence.
LEAST_QUOTE = 12
#: Finding types that need no quote.
QUOTELESS = ("INFO", "MISSING", "CROSS_REF_ERROR", "DRAFTING_DEFECT")
LENSES = {"REGULASYON": ("REGULASYON", "HUKUK"), "VERI_GUVENLIK": ("BILGI_GUVENLIGI", "HUKUK"), "TICARI_RISK": ("MALI", "HUKUK"), "OPERASYONEL": ("OPERASYON", "MALI"), "FIKRI_MULKIYET": ("HUKUK", "MALI"), "SOZLESMESEL": ("HUKUK", "OPERASYON")}


def gap_candidates(contracts: DataFrame, catalogue: DataFrame, detected: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, code, ...): mandatory types of the contract's kind that no clause has. A set
    difference; the catalogue side is small by nature."""
    need = catalogue.filter(F.col("obligation") == "ZORUNLU")
    fits = (F.size("applies_to") == 0) | F.array_contains(F.col("applies_to"), F.col("contract_type"))
    return contracts.join(F.broadcast(need), fits).join(detected, [key, "code"], "left_anti")


def keyword_presence(text: Column, keywords: Column) -> Column:
    """How many keywords occur as plain substrings of the folded text."""
    return let(fold(text), lambda low: F.size(F.filter(keywords, lambda k: F.contains(low, fold(k)))))


def _keyword_counts(rows: DataFrame, contracts: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with ``hits``: keywords that stand in the contract's text, which is folded once for
    all types asked about."""
    asked = rows.groupBy(key).agg(F.collect_list(F.struct("code", "keywords")).alias("asked_"))
    counted = let(fold_text(F.coalesce(text, F.lit(""))), lambda low: F.transform("asked_", lambda x: F.struct(x["code"].alias("code"), F.size(F.filter(x["keywords"], lambda k: F.contains(low, fold(k)))).alias("hits"))))
    hits = asked.join(contracts.select(key, text), key).select(key, F.explode(counted).alias("x")).select(key, "x.code", "x.hits")
    return rows.join(hits, [key, "code"])


def detect_gaps(contracts: DataFrame, catalogue: DataFrame, detected: DataFrame, key: str = "contract_id", text: str = "text", verdicts: DataFrame | None = None) -> DataFrame:
    """MISSING findings: absent words say YOK at the catalogue's severity, present ones KISMEN at
    ORTA (the protection may be there: look by hand); a verdict VAR drops the candidate."""
    rows = _keyword_counts(gap_candidates(contracts.drop(text), catalogue, detected, key), contracts, key, text)
    model = F.lit(None).cast("string")
    if verdicts is not None:
        rows, model = rows.join(verdicts.select(key, "code", F.col("status").alias("told")), [key, "code"], "left"), F.col("told")
    status = F.coalesce(model, F.when(F.col("hits") < 1, "YOK").otherwise("KISMEN"))
    return rows.withColumn("status", status).filter("status != 'VAR'").select(
        key, "code", F.lit("MISSING").alias("finding_type"), "status", "hits", F.when(F.col("status") == "YOK", F.col("severity_if_missing")).otherwise("ORTA").alias("severity"),
        F.when(model.isNull(), 0.65).otherwise(0.8).alias("confidence"), F.lit(None).cast("boolean").alias("verified"),
    )


def ground(findings: DataFrame, clauses: DataFrame, docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """``findings`` with ``kept``, ``reason``, capped ``confidence``, and ``quote_start``, ``quote_end``: the
    place of the quote in its clause, null where it stands elsewhere.

    A quote must stand in its clause (by order_index), else in the whole text, which
    caps the confidence at 0.6; without a quote only types that point at nothing stay.
    Whole texts are folded once each, for the quotes that their clauses do not hold.
    """
    bare = F.coalesce("quote", F.lit("")) == ""
    own = clauses.select(key, "order_index", F.col("text").alias("clause_text_"))
    rows = findings.join(own, [key, "order_index"], "left").withColumn("span_", F.when(~bare, quote_span(F.coalesce("clause_text_", F.lit("")), F.col("quote")))).drop("clause_text_")
    rows = stored(rows, "ground-clauses")
    asked = rows.filter(~bare & F.col("span_").isNull()).groupBy(key).agg(F.collect_set("quote").alias("quotes_"))
    found = let(F.struct(F.coalesce(text, F.lit("")).alias("t"), fold_text(F.coalesce(text, F.lit(""))).alias("f")), lambda v: F.filter("quotes_", lambda q: let(bare_quote(q), lambda b: (F.length(b) >= LEAST_QUOTE) & (F.contains(v["t"], b) | F.contains(v["f"], fold(b))))))
    there = asked.join(docs.select(key, text), key).select(key, F.explode(found).alias("quote")).withColumn("there_", F.lit(True))
    rows = rows.join(there, [key, "quote"], "left")
    here, there = F.col("span_").isNotNull(), F.coalesce("there_", F.lit(False))
    reason = F.when(bare & ~F.col("finding_type").isin(*QUOTELESS), "alinti yok").when(~bare & ~here & ~there, "alinti kaynak metinde bulunamadi")
    capped = F.when(~bare & ~here & there, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence"))
    out = rows.withColumns({"reason": reason, "confidence": capped, "quote_start": F.col("span_.start"), "quote_end": F.col("span_.end")})
    return out.withColumn("kept", F.col("reason").isNull()).drop("span_", "there_")


def rebut(findings: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts (keys, verdict, suggested_severity): GECERSIZ weakens to a vague DUSUK finding,
    ABARTILI lowers confidence and may lower the severity, never raise it."""
    rows = findings.join(verdicts, keys, "left")
    void, much = F.col("verdict") == "GECERSIZ", F.col("verdict") == "ABARTILI"
    lower = much & F.col("suggested_severity").isin(*SEVERITIES) & (severity_rank(F.col("suggested_severity")) < severity_rank(F.col("severity")))
    return rows.withColumns({
        "confidence": F.when(void, F.round(F.col("confidence") * 0.45, 2)).when(much, F.round(F.col("confidence") * 0.75, 2)).otherwise(F.col("confidence")),
        "finding_type": F.when(void, "AMBIGUOUS").otherwise(F.col("finding_type")),
        "severity": F.when(void, "DUSUK").when(lower, F.col("suggested_severity")).otherwise(F.col("severity")),
    }).drop("verdict", "suggested_severity")


def context_multiplier(category: Column, personal_data: Column, outsourcing: Column) -> Column:
    return F.when((category == "VERI_GUVENLIK") & personal_data, 1.25).when((category == "REGULASYON") & outsourcing, 1.5).otherwise(1.0)


def finding_score(severity: Column, weight: Column, multiplier: Column, confidence: Column) -> Column:
    """Points * weight (3 if unknown) * context * confidence held to 0.4..1, two places."""
    held = F.greatest(F.lit(0.4), F.least(F.lit(1.0), confidence))
    return F.round(severity_points(severity) * F.coalesce(weight, F.lit(3)) * F.coalesce(multiplier, F.lit(1.0)) * held, 2)


def contract_scores(contracts: DataFrame, findings: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, total, red_lines, score, band): findings carry ``score``, ``severity`` and
    ``finding_type``. No findings score 100; any red line at YUKSEK or KRITIK is KIRMIZI."""
    veto = (F.col("finding_type") == "RED_LINE") & F.col("severity").isin("KRITIK", "YUKSEK")
    sums = findings.groupBy(key).agg(F.sum(F.col("score").cast("decimal(18,2)")).cast("double").alias("total"), F.count_if(veto).alias("red_lines"))
    rows = contracts.select(key).join(sums, key, "left").fillna({"total": 0.0, "red_lines": 0})
    rows = rows.withColumn("score", F.round(F.greatest(F.lit(0.0), 100.0 - 100.0 * F.col("total") / (F.col("total") + HALF)), 1))
    return rows.withColumn("band", band(F.col("score"), F.col("red_lines") > 0))


def band(score: Column, veto: Column) -> Column:
    return F.when(veto | (score < 60), "KIRMIZI").when(score < 80, "SARI").otherwise("YESIL")


def ordered_findings(findings: DataFrame, tie: list[str]) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), *tie)


def severity_counts(findings: DataFrame, key: str = "contract_id") -> DataFrame:
    return findings.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count_if(F.col("finding_type") == "MISSING").alias("missing"))


def top_per_group(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` of each group; ``order`` must end in a tie-break."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def glossary(findings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct types found that have a plain text, by name."""
    return catalogue.filter(F.col("plain") != "").join(findings.select("code").distinct(), "code", "left_semi").select("code", "name", "plain").orderBy("name", "code")


def clauses_for_model(classified: DataFrame, catalogue: DataFrame, key: str = "contract_id", n: int = 40) -> DataFrame:
    """The heaviest ``n`` clauses of a document, in document order among equals."""
    weights = classified.select(key, "order_index", F.explode("codes.code").alias("code")).join(F.broadcast(catalogue.select("code", "weight")), "code").groupBy(key, "order_index").agg(F.max("weight").alias("weight"))
    return top_per_group(weights, [key], [F.desc("weight"), "order_index"], n)


def effort(weight: Column) -> Column:
    return F.when(weight >= 5, "xhigh").when(weight == 4, "high").when(weight == 3, "medium").otherwise("low")


def lenses(category: Column, weight: Column) -> Column:
    """Which views a heavy clause is read from: two from weight 5, one at 4, none below."""
    known = F.create_map(*[x for k, v in LENSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    base = F.coalesce(F.element_at(known, category), F.array(F.lit("HUKUK")))
    return F.when(weight >= 5, F.slice(base, 1, 2)).when(weight == 4, F.slice(base, 1, 1)).otherwise(F.array().cast("array<string>"))
