"""Resumable stages: an ordered list of table-to-table steps and a manifest of what is finished.

A stage works on items: whole contracts, or clauses of them. Its rows are written into a
partition of their own batch, and only then the manifest gets a row for each item, so a
batch that was cut off is never read and its items are simply still to do. What remains
is an anti-join against the manifest on (contract, item, fingerprint of the input); a
changed contract is therefore done anew, and the newest batch of an item counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import measured_broadcasts, stored

KEY = "contract_id"
ITEM = [KEY, "item", "fingerprint"]


@dataclass
class Stage:
    """``run(tables, todo)`` gives the rows of the contracts in ``todo`` (contract_id, fingerprint) from
    the finished tables of the stages before, which hold these contracts alone. With ``items``, ``items(tables, todo)`` lists
    (contract_id, item) and ``run`` gets these rows and returns an ``item`` column; ``batches`` such parts
    are finished one after the other."""

    name: str
    run: Callable[[dict[str, DataFrame], DataFrame], DataFrame]
    items: Callable[[dict[str, DataFrame], DataFrame], DataFrame] | None = None
    batches: int = 1


@dataclass
class Run:
    spark: SparkSession
    root: str
    stages: list[Stage]
    key_type: str = "string"

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def manifest(self) -> DataFrame:
        """(stage, contract_id, item, fingerprint, batch, rows): finished items, every batch of them."""
        schema = f"{KEY} {self.key_type}, item string, fingerprint string, rows long, stage string, batch string"
        try:
            return self.spark.read.schema(schema).parquet(self._path("manifest"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _marks(self, stage: str) -> DataFrame:
        """Finished items of a stage, ``newest`` where no later batch did them again."""
        order = Window.partitionBy(KEY, "item").orderBy(F.desc("batch"))
        return self.manifest().filter(F.col("stage") == stage).withColumn("newest", F.row_number().over(order) == 1)

    def _batches(self, stage: str, batches: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self._path(stage)).parquet(*[f"{self._path(stage)}/batch={b}" for b in batches])

    def table(self, stage: str, asked: DataFrame | None = None) -> DataFrame:
        """Finished rows of a stage, all or those of the contracts in ``asked``. Batches of which every
        row counts, which is most, are taken by their partition alone."""
        marks = self._marks(stage)
        good = F.col("newest")
        if asked is not None:
            marks = marks.join(asked.select(KEY).distinct().withColumn("asked_", F.lit(True)), KEY, "left")
            good = good & F.coalesce("asked_", F.lit(False))
        batches = marks.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good")).collect()
        found = self._batches(stage, [r["batch"] for r in batches])
        mixed = [r["batch"] for r in batches if r["good"] < r["n"]]
        if mixed:
            keys = [KEY, "item", "batch"] if "item" in found.columns else [KEY, "batch"]
            found = found.join(marks.filter(good).select(*keys).distinct(), keys, "left_semi")
        return found.drop("batch")

    def _commit(self, stage: Stage, inputs: dict[str, DataFrame], todo: DataFrame, whole: bool) -> str:
        # A batch of all contracts takes the tables as they are: cutting them shuffles every text.
        if not whole:
            inputs = {name: t.join(todo.select(KEY).distinct(), KEY, "left_semi") for name, t in inputs.items()}
        batch = f"b{time.time_ns():020d}"
        path = f"{self._path(stage.name)}/batch={batch}"
        stage.run(inputs, todo if stage.items else todo.drop("item")).write.mode("overwrite").parquet(path)
        keys = [KEY, "item"] if stage.items else [KEY]
        written = self.spark.read.parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        marks = todo.select(*ITEM).join(written, keys, "left").select(*ITEM, F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))
        # The files of the mark appear together when its folder does, so a batch is finished or it is not.
        marks.write.parquet(f"{self._path('manifest')}/stage={stage.name}/batch={batch}")
        return batch

    def resume(self, contracts: DataFrame) -> dict[str, DataFrame]:
        """Runs what is not finished for ``contracts`` (contract_id, fingerprint, further columns, which
        the stages see as table ``contracts``); gives the finished tables by stage."""
        with measured_broadcasts(self.spark):
            tables = self._finish(contracts.filter(F.col(KEY).isNotNull()))
        # Joins of the finished tables are planned later, under the session's settings, hence the hint.
        return {name: t.hint("merge") for name, t in tables.items()}

    def _finish(self, contracts: DataFrame) -> dict[str, DataFrame]:
        tables = {"contracts": contracts}
        # Written once, as a fingerprint reads the whole contract.
        asked = stored(contracts.select(KEY, "fingerprint"), "asked")
        for stage in self.stages:
            items = stage.items(tables, asked).join(asked, KEY) if stage.items else asked.withColumn("item", F.lit(""))
            done = self._marks(stage.name).filter("newest")
            fresh = done.isEmpty()
            whole = fresh and stage.batches == 1
            left = items.select(*ITEM) if fresh else items.select(*ITEM).join(done, ITEM, "left_anti")
            for part in range(stage.batches):
                mine = left if stage.batches == 1 else left.filter(F.pmod(F.xxhash64(KEY, "item"), F.lit(stage.batches)) == part)
                # The first batch of all is written even where it is empty: it gives the table its columns.
                if fresh or not mine.isEmpty():
                    batch = self._commit(stage, tables, mine, whole)
            tables[stage.name] = self._batches(stage.name, [batch]).drop("batch") if whole else self.table(stage.name, asked)
        return tables

    def progress(self, contracts: DataFrame) -> DataFrame:
        """(contract_id, done, percent): how many stages are finished for each contract, by whole stages."""
        done = self.manifest().join(contracts.select(KEY, "fingerprint"), [KEY, "fingerprint"], "left_semi").groupBy(KEY).agg(F.count_distinct("stage").alias("done"))
        rows = contracts.select(KEY).join(done, KEY, "left")
        return rows.select(KEY, F.coalesce("done", F.lit(0)).alias("done"), F.round(100.0 * F.coalesce("done", F.lit(0)) / len(self.stages), 1).alias("percent"))
