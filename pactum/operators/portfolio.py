"""Portfolio, usage, lineage, audit and budgets: aggregates over run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEVERITIES


def visible(contracts: DataFrame, deleted: str = "silindi_at", hidden: str = "listede_gizli") -> DataFrame:
    """What every read goes through: not deleted, not hidden."""
    return contracts.filter(F.col(deleted).isNull() & ~F.coalesce(F.col(hidden), F.lit(False)))


def portfolio_rows(contracts: DataFrame, findings: DataFrame, key: str, severity: str = "severity", kinds: tuple[str, ...] = SEVERITIES, missing: Column | None = None) -> DataFrame:
    """Contracts with finding counts by severity. Findings of contracts that are not there
    drop by the join; contracts without findings count 0."""
    counts = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n_total"), *[F.count_if(F.col(severity) == k).alias(f"n_{k}") for k in kinds], F.count_if(missing if missing is not None else F.lit(False)).alias("n_missing"))
    return contracts.join(counts, key, "left").fillna(0, ["n_total", "n_missing", *[f"n_{k}" for k in kinds]])


def portfolio_summary(rows: DataFrame, score: str, band: Column, finished: Column) -> DataFrame:
    """One row: totals, bands and mean score of finished contracts (null if there is none)."""
    done = lambda c: F.count_if(finished & (band == c))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(finished).alias("finished"), *[done(b).alias(b) for b in ("YESIL", "SARI", "KIRMIZI")], F.round(F.avg(F.when(finished, F.col(score).cast("decimal(18,4)"))).cast("double"), 1).alias("avg_score"), F.sum("n_total").alias("findings"))


def top_counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties by value."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def riskiest(rows: DataFrame, by: str, score: str, n: int) -> DataFrame:
    """The ``n`` lowest mean scores; blank names are unknown and left out."""
    known = rows.filter(F.trim(F.coalesce(F.col(by), F.lit(""))) != "")
    mean = F.round(F.avg(F.col(score).cast("decimal(18,4)")).cast("double"), 1)
    return known.groupBy(by).agg(mean.alias("avg_score"), F.count(F.lit(1)).alias("n")).orderBy("avg_score", by).limit(n)


def usage_totals(calls: DataFrame) -> DataFrame:
    """calls (ok, model, input, output, cache_read, cache_write, cost, latency_ms, error, at).
    Latency averages successes only; cost is known only if every named model has a price."""
    ok = F.col("ok")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), *[total(c) for c in ("input", "output", "cache_read", "cache_write", "latency_ms")],
        F.coalesce(F.sum(F.col("input") + F.col("output") + F.col("cache_read")), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(F.col("cost").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("cost"),
        F.round(F.avg(F.when(ok, F.col("latency_ms"))), 3).alias("avg_latency_ok"), F.min_by("error", "at").alias("first_error"), F.min_by("model", "at").alias("first_model"),
    )


def usage_by_agent(calls: DataFrame) -> DataFrame:
    """One row an agent, dearest first; latency here averages all calls."""
    return calls.groupBy("agent").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.col("cost").cast("decimal(18,6)")).cast("double").alias("cost"), F.round(F.avg("latency_ms"), 3).alias("avg_latency_all"), F.min_by("model", "at").alias("model")).orderBy(F.desc("cost"), "agent")


def usage_by_run(calls: DataFrame, run: str = "run") -> DataFrame:
    """One row a run: calls, failures, tokens, cost, and the mean latency of its successes."""
    return calls.groupBy(run).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.col("input") + F.col("output")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.col("cost").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("cost"), F.round(F.avg(F.when(F.col("ok"), F.col("latency_ms"))), 3).alias("avg_latency_ok"),
    )


def stage_sets(calls: DataFrame, run: str = "run", kind: str = "agent") -> DataFrame:
    """(run, done, failed): which kinds of work a run has finished and which only failed."""
    per = calls.groupBy(run, kind).agg(F.bool_or("ok").alias("any_ok"))
    some = lambda keep, name: F.array_sort(F.collect_list(F.when(keep, F.col(kind)))).alias(name)
    return per.groupBy(run).agg(some(F.col("any_ok"), "done"), some(~F.col("any_ok"), "failed"))


def priced(calls: DataFrame, prices: DataFrame, manual: tuple[float, float] | None = None, default: tuple[float, float] | None = None) -> DataFrame:
    """``calls`` (model, provider) with ``price_in`` and ``price_out``: the price entered by hand, else the
    table's for the provider's model, else the table's for the model of any provider (a row
    without a provider), else the default, else null: an unknown price is not made up. A price
    listed twice counts once, the lower one, so calls never multiply. Prices are few."""
    if manual:
        return calls.withColumns({"price_in": F.lit(manual[0]), "price_out": F.lit(manual[1])})
    table = prices.filter("model is not null").groupBy("provider", "model").agg(F.min(F.struct("price_in", "price_out")).alias("p"))
    own = table.filter("provider is not null").withColumnRenamed("p", "p1_")
    any_ = table.filter("provider is null").select("model", F.col("p").alias("p2_"))
    rows = calls.join(F.broadcast(own), ["provider", "model"], "left").join(F.broadcast(any_), "model", "left")
    fallback = F.struct(*[F.lit(x).cast("double").alias(n) for x, n in zip(default or (None, None), ("price_in", "price_out"), strict=True)])
    found = F.coalesce("p1_", "p2_", fallback)
    return rows.withColumns({"price_in": found["price_in"], "price_out": found["price_out"]}).drop("p1_", "p2_")


def page_of(offsets: DataFrame, pages: DataFrame, key: str, at: str = "at") -> DataFrame:
    """``offsets`` with the ``page`` whose [start, end] holds the place ``at``; null where none
    does. A page starts after the one before ends, so one running maximum finds it."""
    marks = pages.select(key, F.col("start").alias(at), F.struct("start", "page", "end").alias("p_"), F.lit(0).alias("o_"))
    asked = offsets.withColumns({"p_": F.lit(None).cast(marks.schema["p_"].dataType), "o_": F.lit(1)})
    last = F.max("p_").over(Window.partitionBy(key).orderBy(at, "o_").rowsBetween(Window.unboundedPreceding, 0))
    found = asked.unionByName(marks, allowMissingColumns=True).withColumn("l_", last).filter("o_ = 1")
    return found.withColumn("page", F.when(F.col(at) <= F.col("l_.end"), F.col("l_.page"))).drop("p_", "o_", "l_")


def cost_known(calls: DataFrame, prices: DataFrame) -> DataFrame:
    priced = calls.filter(F.coalesce("model", F.lit("")) != "").select("model").distinct().join(F.broadcast(prices.select("model", F.lit(True).alias("p"))), "model", "left")
    return priced.agg(((F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(F.coalesce("p", F.lit(False))), F.lit(False))).alias("cost_known"))


def call_cost(input_: Column, output: Column, cache_read: Column, cache_write: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars: cached reads cost a tenth, cache writes a quarter more; prices are per million."""
    return (input_ * price_in + cache_read * price_in * 0.1 + cache_write * price_in * 1.25 + output * price_out) / 1_000_000


def latest(rows: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    """The newest row of each group."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie)))).filter("r_ = 1").drop("r_")


def most_frequent(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the mode; ties by value."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r_", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).filter("r_ = 1").drop("r_")


def attach_to_single(rows: DataFrame, parents: DataFrame, by: str, parent_id: str) -> DataFrame:
    """Gives rows the parent id where their group has exactly one parent, else null."""
    single = parents.groupBy(by).agg(F.count(F.lit(1)).alias("c_"), F.min(parent_id).alias("parent")).filter("c_ = 1").drop("c_")
    return rows.join(single, by, "left")


def earliest_actor(audit: DataFrame, by: str, actor: str, at: str) -> DataFrame:
    return audit.groupBy(by).agg(F.min_by(actor, F.struct(at, actor)).alias("actor"))


def exists_label(rows: DataFrame, others: DataFrame, by: str, yes: str, no: str) -> DataFrame:
    marks = others.select(by).distinct().withColumn("m_", F.lit(True))
    return rows.join(marks, by, "left").withColumn("label", F.when(F.col("m_"), yes).otherwise(no)).drop("m_")


def audit_of(audit: DataFrame, newest: int, order: list, touches: Column) -> DataFrame:
    """Entries that touch something, among the newest ``newest``: the limit comes first."""
    return audit.orderBy(*order).limit(newest).filter(touches)


def audit_of_contracts(audit: DataFrame, contracts: DataFrame, reports: DataFrame, newest: int, order: list) -> DataFrame:
    """Among the newest ``newest`` entries of ``audit`` (entity_type, entity_id, ...), those that touch one
    of ``contracts`` (contract_id) or one of their ``reports`` (report_id, contract_id), in order. The
    sides are two semi-joins on different keys; an entry has one type, so none comes twice."""
    recent = audit.orderBy(*order).limit(newest)
    mine = reports.join(contracts.select("contract_id").distinct(), "contract_id", "left_semi").select(F.col("report_id").alias("entity_id"))
    own = recent.filter("entity_type = 'contract'").join(contracts.select(F.col("contract_id").alias("entity_id")), "entity_id", "left_semi")
    of_reports = recent.filter("entity_type = 'report'").join(mine, "entity_id", "left_semi")
    return own.unionByName(of_reports).orderBy(*order)


def fan_in(base: DataFrame, key: str, **sides: DataFrame) -> DataFrame:
    """``base`` with one sorted array of rows for each side; sides never multiply each other."""
    for name, side in sides.items():
        cols = [c for c in side.columns if c != key]
        base = base.join(side.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), key, "left")
    return base


def remaining(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not done yet: resume is an anti-join on the natural key."""
    return items.join(done, keys, "left_anti")


def progress(checkpoints: DataFrame, key: str) -> DataFrame:
    """Percent of stages done plus the fraction of the running one, at most 100."""
    part = F.max(F.when(F.col("status") == "RUNNING", F.col("items_done") / F.nullif("items_total", F.lit(0))))
    done = F.count_if(F.col("status") == "DONE") + F.coalesce(part, F.lit(0.0))
    return checkpoints.groupBy(key).agg(F.round(F.least(F.lit(100.0), done / F.count(F.lit(1)) * 100), 1).alias("percent"))


def budget_cutoff(calls: DataFrame, key: str, order: list, caps: dict[str, float]) -> DataFrame:
    """(key, cutoff): the first call before which a running total had reached its cap; null if
    none. ``caps`` maps columns to caps; ``calls`` as a column name counts calls."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.withColumn("seq", F.row_number().over(w))
    over = F.lit(False)
    for col, cap in caps.items():
        spent = F.col("seq") - 1 if col == "calls" else F.coalesce(F.sum(F.col(col).cast("decimal(18,6)")).over(before), F.lit(0))
        over = over | (spent >= F.lit(cap))
    return rows.withColumn("over_", over).groupBy(key).agg(F.min(F.when(F.col("over_"), F.col("seq"))).cast("long").alias("cutoff"), F.count(F.lit(1)).alias("calls"))


def breaker_trips(calls: DataFrame, key: str, order: list, limit: int = 3) -> DataFrame:
    """(key, trips, longest): islands of consecutive failures of at least ``limit``."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = calls.withColumn("island", F.count_if(F.col("ok")).over(w))
    runs = rows.filter(~F.col("ok")).groupBy(key, "island").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(key).agg(F.count_if(F.col("run") >= limit).alias("trips"), F.max("run").alias("longest"))


def orphans(runs: DataFrame, owner: str, now: Column, stale_seconds: int) -> DataFrame:
    """Unfinished runs of another owner, or whose heartbeat is stale; cancelled runs are none."""
    stale = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > stale_seconds, F.lit(True))
    return runs.filter(F.col("status").isin("PENDING", "RUNNING") & ~F.coalesce("cancelled", F.lit(False)) & ((F.col("owner_id") != owner) | stale))


def retention_mark(contracts: DataFrame, created: str, now: Column, days: int, running: Column) -> DataFrame:
    """``contracts`` with ``expired``: older than ``days`` and not running; 0 days is off."""
    old = F.unix_timestamp(now) - F.unix_timestamp(created) > days * 86_400
    return contracts.withColumn("expired", F.lit(days > 0) & old & ~running)


def rollup_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Subtotals at every level of ``by`` (an extension): null marks a total, ``level`` says which."""
    return rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"), F.grouping_id().cast("long").alias("level"))
