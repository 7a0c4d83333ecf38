"""Runs that are cut off and go on, and findings of a model beside those of the rules."""

import pytest
from pyspark.sql import functions as F
from test_analysis import ENTRIES, FAIR, RISKY

from pactum.operators import enrich
from pactum.plans import analysis
from pactum.plans.stages import Run, Stage
from pactum.sources import catalog

SCHEMA = "contract_id string, raw_text string"


@pytest.fixture(scope="module")
def types():
    return catalog.build(ENTRIES, "test")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_killed_run_repeats_nothing(spark, tmp_path):
    tries = []

    def breaks(t, todo):
        tries.append(sorted(r[0] for r in todo.select("contract_id").collect()))
        if len(tries) == 1:
            raise RuntimeError("executor lost")
        return t["first"].join(todo, "contract_id", "left_semi").withColumn("n", F.col("n") * 10)

    asked = []

    def first(t, todo):
        asked.append(sorted(r[0] for r in todo.select("contract_id").collect()))
        return todo.filter("contract_id != 'none'").select("contract_id", F.length("fingerprint").alias("n"))

    run = Run(spark, f"file://{tmp_path}/run", [Stage("first", first), Stage("second", breaks)])
    contracts = spark.createDataFrame([("a", "x"), ("b", "xy"), ("none", "z")], "contract_id string, fingerprint string")
    with pytest.raises(RuntimeError):
        run.resume(contracts)
    assert rows_of(run.progress(contracts).select("percent").distinct()) == ["Row(percent=50.0)"]
    out = run.resume(contracts)
    assert asked == [["a", "b", "none"]] and tries == [["a", "b", "none"]] * 2
    assert {tuple(r) for r in out["second"].collect()} == {("a", 10), ("b", 20)}
    # Only what is new or changed is done; the newest batch of a contract counts.
    more = spark.createDataFrame([("a", "x"), ("b", "changed"), ("c", "q")], "contract_id string, fingerprint string")
    out = run.resume(more)
    assert asked[1:] == [["b", "c"]] and {tuple(r) for r in out["second"].collect()} == {("a", 10), ("b", 70), ("c", 10)}
    assert {r["contract_id"]: r["rows"] for r in run.manifest().filter("stage = 'first'").groupBy("contract_id").agg(F.max("rows").alias("rows")).collect()} == {"a": 1, "b": 1, "c": 1, "none": 0}


def test_a_batch_without_its_manifest_is_not_read(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}/run", [Stage("only", lambda t, todo: todo.select("contract_id", F.lit(1).alias("n")))])
    contracts = spark.createDataFrame([("a", "x")], "contract_id string, fingerprint string")
    run.resume(contracts)
    spark.createDataFrame([("a", 99, "b99999999999999999999")], "contract_id string, n int, batch string").write.mode("append").partitionBy("batch").parquet(f"file://{tmp_path}/run/only")
    assert {tuple(r) for r in run.resume(contracts)["only"].collect()} == {("a", 1)}


def test_analysis_goes_on(spark, types, tmp_path):
    contracts = spark.createDataFrame([("risky", RISKY), ("fair", FAIR)], SCHEMA)
    root = f"file://{tmp_path}/analysis"
    once = analysis.analyse(contracts, types, root=root)
    want = rows_of(once.scores)
    before = once.run.manifest().select("stage", "batch").distinct().count()
    more = contracts.unionByName(spark.createDataFrame([("new", RISKY)], SCHEMA))
    again = analysis.analyse(more, types, root=root)
    assert rows_of(again.scores.filter("contract_id != 'new'")) == want
    fresh = again.run.manifest().groupBy("stage", "batch").agg(F.collect_set("contract_id").alias("c")).collect()
    assert len(fresh) > before and sum(r["c"] == ["new"] for r in fresh) == len(fresh) - before
    assert again.scores.filter("contract_id = 'new'").select("total", "band").first() == again.scores.filter("contract_id = 'risky'").select("total", "band").first()


def judge():
    """An enricher that judges payment clauses, breaks off in the middle of a reply to others, and
    fails on lenses."""

    def model(prompts):
        import json

        out = []
        for p in prompts:
            if p["lens"]:
                out.append({"error": "HTTP 429"})
            elif p["code"] == "PAY":
                found = [
                    {"finding_type": "RED_LINE", "severity": "ÇOK", "title": "vade yok", "rationale": "Vade belirtilmemiş", "quote": "Ödeme makul çaba ile yapılır", "legal_basis": ["X 1", "uydurma"], "confidence": 0},
                    {"finding_type": "ONE_SIDED", "severity": "KRITIK", "title": "uydurma", "quote": "Bu cümle hiçbir yerde geçmiyor"},
                ]
                out.append({"reply": "Buyurun:\n```json\n" + json.dumps({"findings": found, "injection_attempt": True}) + "\n```", "model": "m", "input_tokens": 5, "output_tokens": 7, "latency_ms": 1})
            else:
                out.append({"reply": '{"findings": [', "model": "m"})
        return out

    return model


def test_model_findings_beside_rules(spark, types):
    types = [t if t.code != "PAY" else type(t)(**{**t.__dict__, "legal_basis": ("X 1",), "ideal_text": "Fatura 30 gün içinde ödenir."}) for t in types]
    got = analysis.analyse(spark.createDataFrame([("risky", RISKY)], SCHEMA), types, enricher=judge(), parts=3)
    found = {(r["code"], r["finding_type"], r["title"]): r for r in got.findings.filter("clause_number is not null").collect()}
    pay = {k[1:]: r for k, r in found.items() if k[0] == "PAY"}
    # The model judged the payment clause, so its rules give way; the other reply is no JSON, so there they stand.
    assert set(pay) == {("WEAK", "vade yok"), ("INFO", "Metinde modele yönelik talimat")}
    weak = pay["WEAK", "vade yok"]
    assert (weak["severity"], weak["confidence"], weak["legal_basis"], weak["proposed_text"], weak["detected_by"]) == ("ORTA", 0.8, ["X 1"], "Fatura 30 gün içinde ödenir.", "LLM")
    assert ("SECRECY", "RED_LINE", "bilgi paylaşımı") in found
    assert [r["title"] for r in got.dropped.filter("detected_by = 'LLM'").collect()] == ["uydurma"]
    log = {r["agent"]: r for r in enrich.calls(got.replies).groupBy("agent").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("input").alias("input")).collect()}
    assert log["RiskAnalyst"]["failed"] == 0 and log["RiskAnalyst"]["input"] == 5 and log["RiskAnalyst/BILGI_GUVENLIGI"]["ok"] == 0


def test_an_enricher_that_raises_leaves_the_rules(spark, types):
    contracts = spark.createDataFrame([("risky", RISKY)], SCHEMA)

    def broken(prompts):
        raise OSError("no network")

    plain, other = analysis.analyse(contracts, types), analysis.analyse(contracts, types, enricher=broken)
    assert rows_of(plain.scores) == rows_of(other.scores)
    assert {r["error"] for r in plain.replies.collect()} == {"no model"} and {r["error"] for r in other.replies.collect()} == {"OSError: no network"}


def test_prompts(spark, types):
    rows = [("c", 0, "1", "Gizlilik", "Tedarikçi makul çaba gösterir; gizli bilgi, gizlilik.", [("SECRECY", 0.9, "KEYWORD")], ("Lodos",))]
    df = spark.createDataFrame(rows, "contract_id string, order_index int, number string, heading string, text string, codes array<struct<code string, confidence double, method string>>, b struct<x string>")
    df = df.withColumn("parties", F.struct(F.array(F.lit("Lodos")).alias("buyers"), F.array().cast("array<string>").alias("suppliers")))
    hits = spark.createDataFrame([("c", 0, "SECRECY", "SEC_SHARE")], "contract_id string, order_index int, code string, rule_id string")
    got = {r["lens"]: r for r in enrich.prompt_rows(df, types, catalog.to_frame(spark, types), hits).collect()}
    assert set(got) == {"", "BILGI_GUVENLIGI", "HUKUK"} and got[""]["effort"] == "xhigh"
    assert got[""]["prompt"].split("\n") == ["Alıcı: Lodos", "Madde 1 Gizlilik", "Tip: SECRECY, Gizlilik, ağırlık 5, ZORUNLU", "<madde>", rows[0][4], "</madde>", "Denetim listesi:", "1. [YUKSEK] bilgi paylaşımı (kural eşleşti)", "Ölçülemez ifadeler: makul çaba"]
    assert got["HUKUK"]["prompt"].startswith("Bakış: HUKUK\n")
