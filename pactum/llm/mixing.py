"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

The corpus is a stream of equal-token blocks: documents of a source are dealt to
shards of bounded size, and a shard's tokens, in seeded document order, are cut
every ``block`` tokens. Seats (blocks) go to sources, then to groups of shards,
then to shards, each time by highest quotient weight / (2k - 1). A shard takes all
its blocks as often as its quota holds them, and the rest by a seeded permutation.
What whole blocks leave over in a source (less than a block a shard) is settled by
the head of one more block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored

BLOCK = 16
#: Tokens of a shard: the window that lays out its documents stays this small.
SHARD_TOKENS = 1 << 18
GROUP_SHARDS = 1024
WEIGHTS = (5, 2, 1)
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000
#: Primes above any block count of a shard, so multiplying by one permutes the blocks.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def sainte_lague(parties: DataFrame, within: list[str], weight: str, seats: str, tie: list[str]) -> DataFrame:
    """``parties`` with ``quota``: the column ``seats`` (one value in each ``within``
    group) shared by highest quotients; equal quotients go by ``tie``.

    A party's quota lies between its rounded shares of seats - n/2 and seats + n/2,
    so only the quotients in between, about two a party, are ranked.
    """
    group = Window.partitionBy(*within)
    total, n = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    share = F.when(F.col("sl_total") > 0, F.col(weight) / F.col("sl_total")).otherwise(F.lit(0.0))
    bounded = parties.withColumns({"sl_total": total.cast("double"), "sl_n": n}).withColumns({
        "sl_low": F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("sl_n") / 2) - 0.5)).cast("long"),
        "sl_high": F.ceil(share * (F.col(seats) + F.col("sl_n") / 2) + 0.5).cast("long"),
    })
    bounded = bounded.withColumn("sl_left", F.col(seats) - F.sum("sl_low").over(group))
    key = list(dict.fromkeys([*within, *tie]))
    seat = bounded.select(*key, "sl_left", F.col(weight).alias("sl_w"), F.explode(F.sequence(F.col("sl_low") + 1, F.greatest(F.col("sl_high"), F.col("sl_low") + 1))).alias("k"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(F.col("sl_w") / (2 * F.col("k") - 1)), *tie, "k"))
    won = seat.withColumn("r", rank).filter(F.col("r") <= F.col("sl_left")).groupBy(*key).agg(F.count(F.lit(1)).alias("sl_won"))
    return bounded.join(won, key, "left").withColumn("quota", F.col("sl_low") + F.coalesce("sl_won", F.lit(0))).drop("sl_total", "sl_n", "sl_low", "sl_high", "sl_left", "sl_won")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with ``src`` (rank by code point, null last) and ``target``.

    ``share`` of all tokens goes to sources by weight; a target stops at ``most``
    times its source and the excess goes to the others by weight. With sources in
    order of cap over weight, the first whose even rate is within its cap sets the rate
    of all that follow. Runs over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("src", F.row_number().over(order) - 1)
    ranked = ranked.withColumns({"w": F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")).cast("double"), "cap": F.col("source_size") * F.lit(float(most))})
    by_rate = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before, after, whole = by_rate.rowsBetween(Window.unboundedPreceding, -1), by_rate.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rate = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    found = F.when(F.col("rate") <= F.col("cap") / F.col("w"), F.struct("place", "rate"))
    ranked = ranked.withColumns({"rate": rate, "place": F.row_number().over(by_rate)})
    return ranked.withColumn("rate", F.min(found).over(whole)["rate"]).withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("rate"), F.col("cap")))).drop("rate", "cap", "w", "place")


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; one row for each row of ``docs``.

    ``size`` counts words ``[^\\x20\\x09-\\x0D]+``; null text has none and is never
    taken. Null sources are one source. ``taken`` is at most twice ``size``. Blocks
    depend on ids, sizes, texts (of rows without an id or with a repeated one) and the
    seed alone, so reruns agree; rows that repeat an id are laid out one after the
    other, and a row without an id stands where its text puts it. An empty table gives
    an empty result.
    """
    return _taken(docs, seed, block, shard_tokens).select("doc_id", "source", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, seed: int, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, carry: bool = False) -> DataFrame:
    """``mix`` with ``place`` (the id, or a hash of the text of a row without one) and ``nth``
    (of the rows at one place, from 0); with ``carry``, ``row`` holds the row's own columns."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    slim = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    sized = stored(slim.drop("row"), "mix-sizes")
    sources = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumns({
        "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"),
        "seats": F.floor(F.sum("target").over(Window.partitionBy()) / block).cast("long"),
    }), "mix-sources")
    sources = sainte_lague(sources, [], "target", "seats", ["src"]).withColumnRenamed("quota", "src_quota")
    small = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources

    def place(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("place", F.coalesce("doc_id", "mark"))
        return rows.join(small, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumns({
            "shard": F.pmod(F.xxhash64(F.lit(seed), "place"), F.col("shards")), "at": F.xxhash64(F.lit(seed + 1), "place"),
        })

    placed = place(sized)
    shards = placed.filter("size > 0").groupBy("src", "src_quota", "shard").agg(F.sum("size").alias("tokens")).withColumn("wide", F.floor(F.col("shard") / GROUP_SHARDS))
    wide = shards.groupBy("src", "src_quota", "wide").agg(F.sum("tokens").alias("wide_tokens"))
    wide = sainte_lague(wide, ["src"], "wide_tokens", "src_quota", ["wide"]).withColumnRenamed("quota", "wide_quota").drop("src_quota")
    quotas = sainte_lague(shards.drop("src_quota").join(wide, ["src", "wide"]), ["src", "wide"], "tokens", "wide_quota", ["shard"])
    quotas = stored(quotas.withColumn("tokens_due", F.least(F.col("quota") * block, 2 * F.col("tokens"))).select("src", "shard", "tokens", "tokens_due"), "mix-quotas")
    # Whole blocks leave less than one block a shard over; the first shard of a source settles it.
    owed = quotas.groupBy("src").agg(F.sum("tokens_due").alias("due"), F.min("shard").alias("shard")).join(sources.select("src", F.round("target").cast("long").alias("whole")), "src")
    quotas = quotas.join(owed.select("src", "shard", (F.col("whole") - F.col("due")).alias("owed")), ["src", "shard"], "left")
    due = F.greatest(F.lit(0), F.least(F.col("tokens_due") + F.coalesce("owed", F.lit(0)), 2 * F.col("tokens")))
    some = F.greatest(F.col("tokens"), F.lit(1))
    quotas = quotas.select(
        "src", "shard", F.floor(due / some).alias("passes"), F.floor(due % some / block).alias("extra"), (due % some % block).alias("rest"), F.floor(F.col("tokens") / block).alias("full"),
        F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), some).alias("shift"),
        F.element_at(F.array(*map(F.lit, STRIDES)), (F.pmod(F.xxhash64(F.lit(seed + 2), "src", "shard"), F.lit(len(STRIDES))) + 1).cast("int")).cast("long").alias("stride"),
    )
    # Laid out within (src, shard), whose rows one task sorts; the same keys join the quotas.
    lay = Window.partitionBy("src", "shard").orderBy("at", "place", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    repeats = Window.partitionBy("src", "shard", "at", "place").orderBy("size", "mark")
    every = place(slim) if carry else placed
    # Rows without words are never taken, so they need no place in a shard.
    none = every.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", "place", F.lit(0).alias("nth"), *(["row"] if carry else []), F.lit(0).cast("long").alias("taken"))
    laid = every.filter("size > 0").withColumns({"start": F.sum("size").over(lay) - F.col("size"), "nth": F.row_number().over(repeats) - 1}).join(quotas, ["src", "shard"])
    end = F.col("start") + F.col("size")
    # The full blocks in seeded order, then the short last one; the block after the chosen ones gives its head.
    rank = lambda k: F.when(k < F.col("full"), F.pmod(F.col("stride") * k + F.col("shift"), F.col("full"))).otherwise(k)
    head = lambda k: F.when(rank(k) < F.col("extra"), F.lit(block)).when(rank(k) == F.col("extra"), F.col("rest")).otherwise(F.lit(0))
    inside = lambda k: F.greatest(F.lit(0), F.least(end, k * block + head(k)) - F.greatest(F.col("start"), k * block))
    first, last = F.floor(F.col("start") / block), F.floor((end - 1) / block)
    part = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda sum_, k: sum_ + inside(k))
    taken = (F.col("passes") * F.col("size") + part).cast("long")
    return laid.select("doc_id", "source", "size", "source_size", "target", "place", "nth", *(["row"] if carry else []), taken.alias("taken")).unionByName(none)


def repeat_by_mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them: a row appears once for each whole time it is taken, and
    once more with the probability of the rest, drawn by a hash of its id. Rows without
    an id are drawn by their text, and rows that repeat an id or a text each for itself."""
    plan = _taken(docs, seed, carry=True)
    times = F.col("taken") / F.greatest("size", F.lit(1))
    key = F.when(F.col("nth") == 0, F.xxhash64(F.lit(seed + 3), "place")).otherwise(F.xxhash64(F.lit(seed + 3), "place", "nth"))
    draw = F.pmod(key, F.lit(1 << 20)) / float(1 << 20)
    copies = (F.floor(times) + F.when(draw < times - F.floor(times), 1).otherwise(0)).cast("int")
    taken = plan.select("row", copies.alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
