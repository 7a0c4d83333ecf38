"""Exact dedup by a tree-merge of digest runs, in DataFrame operations only.

Every row becomes one small row (digest, length, id), dealt into runs by its place in the
table, so copies spread over all runs whatever their ids. A run keeps one row per digest,
in digest order, with the best identifier seen. Then runs are exchanged in binomial
rounds: with ``width`` runs left, run ``r`` and run ``r + width / 2`` meet, and the merge
keeps, per digest, the best row again, until one run is left, whose key is the digest
alone. At every level rows of one digest must agree in a second hash and in the length,
or the job fails. Copies shrink to one row a task and run before they travel, so a text
that fills a third of the table sends two rows a task of the last round. What was found
goes back the same way: to each run's row of a text, then to the run's copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

KEY = "text_sha256"
RUNS = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """One row per row: doc_id, n_chars (of the original), the digest of the normalised text,
    what it is verified by (a second hash and the length), and the run.

    The run follows the place of the row; it must be stored before it is used twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, SPACES, "")
    return docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), norm.alias("norm")).select(
        "doc_id", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias(KEY), F.struct(F.xxhash64("norm").alias("hash"), F.length("norm").alias("chars")).alias("check"),
        F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(runs)).cast("int").alias("run"),
    )


def _merge(level: DataFrame, best: Column, low: Column, high: Column, n: Column) -> DataFrame:
    """One row per run and digest of ``level``. ``max(struct)`` has no fixed-width buffer, so
    Spark sorts each run by its key and merges neighbours."""
    merged = level.groupBy("run", KEY).agg(F.max(best).alias("best"), F.min(low).alias("low"), F.max(high).alias("high"), F.sum(n).alias("n"))
    unlike = F.raise_error(F.concat(F.lit("unlike texts of one digest: "), F.col(KEY)))
    return merged.withColumn("best", F.when(F.col("low") == F.col("high"), F.col("best")).otherwise(unlike))


def merge_runs(rows: DataFrame, runs: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """Per run and digest, and then per digest, the best row (longest original, then smallest
    id) and the row count. ``runs`` is a power of two; there are log2(runs) rounds."""
    if runs < 1 or runs & (runs - 1):
        raise ValueError(f"{runs} runs do not halve to one")
    best = F.struct("n_chars", F.bitwise_not("doc_id").alias("neg"), F.col("doc_id").alias("id"))
    lowest = merged = _merge(rows, best, F.col("check"), F.col("check"), F.lit(1))
    width = runs
    while width > 1:
        width //= 2
        merged = _merge(merged.withColumn("run", F.col("run") % width), F.col("best"), F.col("low"), F.col("high"), F.col("n"))
    return lowest, merged.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept, text_sha256; dropped rows too.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; the row with the
    most code points, then the smallest id, stays. Null text is empty text. Each row
    gives a row; rows that repeat both id and text share their verdict. A null id
    loses against any other. Extra columns are ignored.
    """
    rows = stored(digests(docs, id_col, text_col, runs), "exact-digests")
    lowest, best = merge_runs(rows, runs)
    # A digest has at most one row a run here, and at most its share of the copies in a run.
    back = lowest.select("run", KEY).join(best.select(KEY, "best", "n"), KEY)
    kept = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == F.col("best.n_chars"))
    return rows.join(back, ["run", KEY]).select("doc_id", F.col("best.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), kept.alias("kept"), KEY)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; of rows that repeat id and
    text one stays. All columns pass through unchanged."""
    columns = docs.columns
    named = {c: f"in_{i}" for i, c in enumerate(columns)}
    key = lambda c: {"k_null": F.col(c).isNull(), "k_id": F.coalesce(F.col(c), F.lit(0))}
    stays = exact_groups(docs, id_col, text_col).filter("kept").withColumns(key("doc_id")).select("k_null", "k_id", F.col("text_sha256").alias("k_sha"))
    norm = F.translate(F.coalesce(F.col(named[text_col]), F.lit("")), SPACES, "")
    held = docs.withColumnsRenamed(named).withColumns({**key(named[id_col]), "k_sha": F.sha2(norm.cast("binary"), 256)})
    held = held.join(stays, ["k_null", "k_id", "k_sha"], "left_semi").dropDuplicates(["k_null", "k_id", "k_sha"])
    return held.select(*[F.col(new).alias(old) for old, new in named.items()])
