"""Mixing sources to target weights: targets by water level, copies by rate and seeded chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shared_dir, stored

#: Sources up to this number may be broadcast; beyond it the join is shuffled.
FEW_SOURCES = 20_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn and share `share` of all sizes.
    A target stops at `most` times its source's size; the rest is shared again by weight until
    none is above. That is one water level: target = least(most * size, level * weight), found with
    running sums over sources in the order of size by weight. One row per source is windowed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("n", F.row_number().over(order)).withColumn("weight", turn).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = F.lit(0)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)
    )
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct("n2", "level"))).over(whole)
    per = per.withColumn("n2", F.row_number().over(fill)).withColumn("found", free.getField("level"))
    target = F.when(F.col("found").isNull() | F.col("capped"), F.col("cap")).otherwise(F.col("found") * F.col("weight"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def copies(docs: DataFrame, seed: int = 7, **kw) -> DataFrame:
    """(row, size, source_size, target, copies): each row of docs as a struct, with how often it is taken: floor(rate) times and, by
    chance of the fraction, once more; rate = target / size of its source.

    The chance is a hash of seed and doc_id, so reruns and rows alike agree; rows without doc_id take a hash of their text
    instead. Null texts have size 0; a null source is a source; sources of size 0 have rate 0. Columns of any names stay
    as they are. Targets are made in windows over one row per source, in one task: fit for sources by the million.
    """
    source = F.col("source").cast("string")
    sized = docs.select(F.struct(*docs.columns).alias("row"), word_count().alias("size"), source.alias("source"))
    goal = stored(targets(docs.select(source.alias("source"), word_count().alias("size")), **kw), f"{shared_dir(docs.sparkSession)}/targets")
    goal = goal.withColumnRenamed("source", "of")
    if goal.count() <= FEW_SOURCES:
        goal = F.broadcast(goal)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.when(F.col("row.text").isNotNull(), F.concat(F.lit("text:"), F.md5(F.col("row.text").cast("string").cast("binary")))), F.lit(""))
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    taken = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("bigint")).cast("bigint")
    return sized.join(goal, F.col("source").eqNullSafe(F.col("of"))).select("row", "size", "source_size", "target", taken.alias("copies"))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    return copies(docs, **kw).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken."""
    return copies(docs, **kw).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
