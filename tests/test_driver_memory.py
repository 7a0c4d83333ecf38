"""What a driver must not hold: rows that grow with the contracts, however small their files are."""

from pyspark.sql import functions as F
from test_analysis import ENTRIES, FAIR, RISKY

from pactum.plans import analysis
from pactum.plans.stages import Run, Stage
from pactum.sources import catalog
from pactum.storage import measured_broadcasts


def planned(df):
    """The join operators before any of them has run: no size is measured yet."""
    text = df._jdf.queryExecution().sparkPlan().toString()
    return [name for name in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin") if name in text]


def test_small_files_are_not_broadcast(spark, tmp_path):
    """A million equal rows take some kilobytes on disk."""
    plans = []

    def second(t, todo):
        out = t["contracts"].select("contract_id").join(t["first"].groupBy("contract_id").count(), "contract_id")
        plans.append(planned(out))
        return out

    run = Run(spark, f"file://{tmp_path}/run", [Stage("first", lambda t, todo: todo.select("contract_id", F.lit("same").alias("x"))), Stage("second", second)])
    contracts = spark.range(20_000).select(F.col("id").cast("string").alias("contract_id"), F.lit("f").alias("fingerprint"))
    out = run.resume(contracts)
    assert plans == [["SortMergeJoin"]] and out["second"].count() == 20_000
    # Nor where finished tables are joined later, nor where only some contracts are left to do.
    assert planned(out["first"].join(out["second"].groupBy("contract_id").agg(F.sum("count")), "contract_id")) == ["SortMergeJoin"]
    more = contracts.withColumn("fingerprint", F.when(F.col("contract_id") < "2", "g").otherwise("f"))
    assert run.resume(more)["second"].count() == 20_000 and plans[1:] == [["SortMergeJoin"]]


def test_settings_come_back(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before, asked = [spark.conf.get(k, None) for k in keys], spark.conf.get(keys[0])
    with measured_broadcasts(spark):
        assert spark.conf.get(keys[0]) == "-1" and spark.conf.get(keys[1]) == (before[1] or asked)
    assert [spark.conf.get(k, None) for k in keys] == before


def test_findings_of_contracts_without_an_id(spark):
    """They have no place in the result, whether a run is new or goes on."""
    types = catalog.build(ENTRIES, "test")
    rows = [("risky", RISKY), (None, FAIR), ("fair", FAIR), (None, None)]
    got = analysis.analyse(spark.createDataFrame(rows, "contract_id string, raw_text string"), types)
    assert {r["contract_id"] for r in got.scores.collect()} == {"risky", "fair"}
    assert planned(got.scores).count("BroadcastHashJoin") <= 1 and "SortMergeJoin" in planned(got.scores)
