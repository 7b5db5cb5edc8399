"""Pools with a quota per country."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import renamed, same, sliced

#: Kinds of qualification that belong to the pool itself.
POOL_TYPES = ("q4", "n4", "q7")


def pre_occupied(entries: DataFrame, event: Sequence[str], country: str = "country", pool_types: Sequence[str] = POOL_TYPES, only_active: Column | None = None) -> DataFrame:
    """Entries per country on fixed routes: not of a pool type; withdrawn and unqualified ones count too,
    unless `only_active` says otherwise."""
    rows = entries.where(~F.col("type").isin(*pool_types))
    rows = rows if only_active is None else rows.where(only_active)
    return rows.groupBy(*event, country).agg(F.count("*").alias("pre"))


def quota_rank(pool: DataFrame, pre: DataFrame, event: Sequence[str], order: Sequence[Column], country: str = "country", cap: int = 3) -> DataFrame:
    """Adds country_rank, ok and pool_rank: the walk from best to worst where an athlete beyond the country's
    cap takes no slot and has no rank. order must have no ties. Only cap rows of a country have a rank, so the window over an event
    holds those alone; the rest is spread over other partitions."""
    p = pool.join(pre, [*event, country], "left").withColumn("pre", F.coalesce("pre", F.lit(0)).cast("bigint"))
    own = Window.partitionBy(*event, country).orderBy(*order)
    p = p.withColumn("country_rank", F.row_number().over(own).cast("bigint")).withColumn("ok", F.col("country_rank") <= cap - F.col("pre"))
    aside = F.when(F.col("ok"), 0).otherwise(1 + F.pmod(F.xxhash64(country, "country_rank"), F.lit(1024)))
    run = Window.partitionBy(*event, "_aside").orderBy(*order)
    return p.withColumn("_aside", aside).withColumn("pool_rank", F.when(F.col("ok"), F.row_number().over(run).cast("bigint"))).drop("_aside")


def quota_rank_huge(pool: DataFrame, pre: DataFrame, event: Sequence[str], order: str, country: str = "country", cap: int = 3, slices: int = 64, then: Sequence[Column] = ()) -> DataFrame:
    """The same for one pool of any size: only the best cap - pre of a country can have a rank, so those are
    found by a pruned window, and ranks come from counts of whole slices of the order plus places within one.
    order: one numeric column, smaller is better; `then` settles its ties.
    """
    p = pool.join(pre, [*event, country], "left").withColumn("pre", F.coalesce("pre", F.lit(0)).cast("bigint"))
    own = Window.partitionBy(*event, country).orderBy(order, *then)
    # WindowGroupLimit: no more than cap rows of a country survive the map side.
    ok = p.withColumn("country_rank", F.row_number().over(own).cast("bigint")).where(f"country_rank <= {cap}").where(F.col("country_rank") <= cap - F.col("pre"))
    edges = ok.groupBy(*event).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    ok = ok.join(edges, list(event)).withColumn("_s", F.least(F.lit(slices - 1), F.floor((F.col(order) - F.col("_lo")) * slices / F.greatest(F.lit(1), F.col("_hi") - F.col("_lo") + 1))))
    before = ok.groupBy(*event, "_s").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*event).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ok.join(before, [*event, "_s"]).withColumn("pool_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*event, "_s").orderBy(order, *then)))
    return ranked.drop("_s", "_lo", "_hi", "_c", "_before")


def rank_by_histogram(rows: DataFrame, by: Sequence[str], score: str, name: str, slices: int = 256) -> DataFrame:
    """Adds the rank of a row within `by`: one more than the number of strictly better scores, nulls last.

    Scores are counted first, so what is ordered is a row per distinct score however many rows a group holds. Those are cut into slices: a window
    sees one slice, and what better slices hold is added from one row per slice, so that a group of nearly unique scores is spread over many tasks. The ranks are
    joined back on (by, score), where AQE may split a hot one.
    """
    keys = [f"_h{i}" for i in range(len(by))]
    hist = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(score).alias("_hs")).agg(F.count("*").alias("_hn"))
    cut = sliced(hist, keys, "_hs", slices)
    better = lambda w: F.coalesce(F.sum("_hn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = cut.groupBy(*keys, "_slice").agg(F.sum("_hn").alias("_hn")).withColumn("_ahead", better(Window.partitionBy(*keys).orderBy(F.col("_slice").desc())))
    ahead = renamed(ahead.drop("_hn"), [*keys, "_slice"], "_a")
    own = cut.withColumn("_own", better(Window.partitionBy(*keys, "_slice").orderBy(F.col("_hs").desc_nulls_last())))
    ranks = own.join(ahead, same(own, ahead, [*keys, "_slice"], "_a")).select(*keys, "_hs", (F.col("_ahead") + F.col("_own") + 1).cast("bigint").alias(name))
    on = F.col(score).eqNullSafe(F.col("_hs"))
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return rows.join(ranks, on).drop("_hs", *keys)


def uncapped_position(pool: DataFrame, event: Sequence[str], score: str, then: Sequence[Column], entry_number: Column, pool_slots: Column) -> DataFrame:
    """Adds uncapped_position: place in the whole pool, by score from high to low and then by `then`, behind the slots that are not the pool's."""
    tied = F.row_number().over(Window.partitionBy(*event, score).orderBy(*then))
    return rank_by_histogram(pool, event, score, "_rank").withColumn("uncapped_position", F.col("_rank") + tied - 1 + (entry_number - pool_slots)).drop("_rank")


def qualifying(ranked: DataFrame, pool_slots: Column, fixed_slots: Column) -> DataFrame:
    """Adds qualifying_position and inside_quota from pool_rank."""
    return ranked.withColumn("qualifying_position", F.col("pool_rank") + fixed_slots).withColumn("inside_quota", F.coalesce(F.col("pool_rank") <= pool_slots, F.lit(False)))


def rank_in_country(pool: DataFrame, event: Sequence[str], score: str, country: str = "country") -> DataFrame:
    """Adds country_place: rank by score behind the country's fixed entries (`pre`)."""
    return rank_by_histogram(pool, [*event, country], score, "country_place").withColumn("country_place", F.col("country_place") + F.coalesce("pre", F.lit(0)))


def projected_place(pool: DataFrame, event: Sequence[str], score: str) -> DataFrame:
    """Adds projected_place: one more than the number of strictly better scores."""
    return rank_by_histogram(pool, event, score, "projected_place")


def displayed_standing(rows: DataFrame) -> DataFrame:
    """Adds standing and standing_kind: the official position if qualified (null, where it is not known), else the capped, else the
    uncapped one."""
    is_official = F.coalesce(F.col("qualified"), F.lit(False))
    kind = F.when(is_official, "official").when(F.col("qualifying_position").isNotNull(), "capped").otherwise("country")
    standing = F.when(is_official, F.col("official_position")).otherwise(F.coalesce("qualifying_position", "uncapped_position"))
    return rows.withColumn("standing", standing).withColumn("standing_kind", kind)
