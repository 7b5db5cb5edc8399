"""What-if questions in bulk, answered from histograms of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def place_among(scenarios: DataFrame, peers: DataFrame, event: Sequence[str], score: str, peer_score: str = "score") -> DataFrame:
    """Adds place: 1 + the number of peers strictly better. Peers become a histogram per event; scenarios and
    histogram are united by score, so no pair of athlete and peer arises. peers must not hold the candidate's own row."""
    keys = [F.col(c) for c in event]
    hist = peers.groupBy(*event, F.col(peer_score).cast("bigint").alias("_s")).agg(F.count("*").alias("_n"))
    asked = scenarios.select(*keys, F.col(score).cast("bigint").alias("_s")).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    both = hist.unionByName(asked).groupBy(*event, "_s").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*event).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    places = both.select(*event, "_s", (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).alias("place"))
    return scenarios.withColumn("_s", F.col(score).cast("bigint")).join(places, [*event, "_s"]).drop("_s")


def quota_place(scenarios: DataFrame, peers: DataFrame, pre: DataFrame, event: Sequence[str], score: str, country: str = "country", peer_score: str = "score", cap: int = 3) -> DataFrame:
    """Adds quota_place (null if blocked), blocked, uncapped_place, country_place.

    Ties go to the candidate. Ahead are, of each other country, its strictly better peers up to the free
    places; the own country blocks once its better peers fill them. Only the best cap - pre of a
    country can matter, so each country gives at most cap steps of a histogram.
    """
    free = F.greatest(F.lit(0), F.lit(cap) - F.coalesce("pre", F.lit(0)))
    p = peers.select(*event, country, F.col(peer_score).cast("bigint").alias("_s"))
    nth = Window.partitionBy(*event, country).orderBy(F.col("_s").desc())
    top = p.withColumn("_k", F.row_number().over(nth)).where(f"_k <= {cap}").join(pre, [*event, country], "left").where(F.col("_k") <= free)
    hist = top.groupBy(*event, "_s").agg(F.count("*").alias("_n"))
    asked = scenarios.select(*event, country, F.col(score).cast("bigint").alias("_s")).distinct()
    both = hist.unionByName(asked.select(*event, "_s", F.lit(0).cast("bigint").alias("_n"))).groupBy(*event, "_s").agg(F.sum("_n").alias("_n"))
    above = Window.partitionBy(*event).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = both.select(*event, "_s", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_ahead"))
    whole = p.groupBy(*event, country, "_s").agg(F.count("*").alias("_n")).unionByName(asked.withColumn("_n", F.lit(0).cast("bigint"))).groupBy(*event, country, "_s").agg(F.sum("_n").alias("_n"))
    own = Window.partitionBy(*event, country).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    mine = whole.select(*event, country, "_s", F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_own"))
    out = scenarios.withColumn("_s", F.col(score).cast("bigint")).join(ahead, [*event, "_s"]).join(mine, [*event, country, "_s"]).join(pre, [*event, country], "left")
    out = out.withColumn("pre", F.coalesce("pre", F.lit(0))).withColumn("blocked", F.col("_own") >= F.greatest(F.lit(0), F.lit(cap) - F.col("pre")))
    out = out.withColumn("quota_place", F.when(~F.col("blocked"), F.col("_ahead") + 1)).withColumn("country_place", F.col("_own") + 1 + F.col("pre"))
    return place_among(out.drop("_s", "_ahead", "_own"), peers, event, score, peer_score).withColumnRenamed("place", "uncapped_place")
