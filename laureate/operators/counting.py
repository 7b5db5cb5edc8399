"""Counting results: windows of eligibility, the best N, substitutes, recounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_disciplines(results: DataFrame, groups: DataFrame) -> DataFrame:
    """Results whose discipline is in a group's list, once per group that lists it; adds the group's columns."""
    listed = groups.withColumn("discipline", F.explode(F.array_distinct("disciplines"))).drop("disciplines")
    return results.join(listed, ["gender", "discipline"])


def counting_order(score: str, points: str, day: str, ord_: str) -> list[Column]:
    return [F.col(score).desc(), F.col(points).desc(), F.col(day).desc(), F.col(ord_).asc()]


def best_per_round(results: DataFrame, round_key: Sequence[str], score: str, ord_: Sequence[str]) -> DataFrame:
    """One row per round: the highest score, the first on ties. Comes before any exclusion."""
    w = Window.partitionBy(*round_key).orderBy(F.col(score).desc(), *ord_)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_n(results: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 5, name: str = "counting_rank") -> DataFrame:
    """The first n by order; the filter on row_number lets Spark prune before the shuffle."""
    return results.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)


def ranking_score(counting: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """floor of the mean, number and least of the counting scores."""
    return counting.groupBy(*key).agg(
        F.floor(F.avg(score)).cast("bigint").alias("ranking_score"), F.count("*").alias("n_counting"), F.coalesce(F.min(score), F.lit(0)).cast("bigint").alias("cap"), F.sum(score).cast("bigint").alias("sum_score")
    )


def window_soundness(counting: DataFrame, key: Sequence[str], inside: Column) -> DataFrame:
    """sound: there are counting results and all lie inside; an unknown day is outside."""
    return counting.groupBy(*key).agg((F.bool_and(F.coalesce(inside, F.lit(False))) & (F.count("*") > 0)).alias("sound"))


def substitutes(pool: DataFrame, counting: DataFrame, caps: DataFrame, key: Sequence[str], result_key: Sequence[str], order: Sequence[Column], score: str) -> DataFrame:
    """Results that do not count now, up to and including the cap, ranked. pool: best per round, in window."""
    rest = pool.join(counting.select(*key, *result_key).distinct(), [*key, *result_key], "left_anti")
    rest = rest.join(caps.select(*key, "cap"), list(key)).where(F.col(score) <= F.col("cap"))
    return rest.withColumn("substitute_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def recount(counting: DataFrame, subs: DataFrame, removed: DataFrame, key: Sequence[str], result_key: Sequence[str], score: str) -> DataFrame:
    """Ranking scores after the rows of `removed` (key, result_key) are taken out and the freed slots are
    filled with the best substitutes. All rows that share a removed key go. Only athletes with a removal are returned."""
    gone = counting.join(removed.select(*key, *result_key).distinct(), [*key, *result_key], "left_semi").groupBy(*key).agg(F.count("*").alias("freed"))
    kept = counting.join(removed.select(*key, *result_key).distinct(), [*key, *result_key], "left_anti").join(gone.select(*key), list(key), "left_semi")
    filled = subs.join(gone, list(key)).where("substitute_rank <= freed")
    return ranking_score(kept.select(*key, score).unionByName(filled.select(*key, score)), key, score)


def with_one_more(base: DataFrame, added: str, n: int = 5) -> DataFrame:
    """What one more result does: base has n_counting, sum_score, cap (its least). Adds new_score, counts, dropped.
    It counts if there is a free slot, or if it beats the least."""
    full = F.col("n_counting") >= n
    counts = ~full | (F.col(added) > F.col("cap"))
    total = F.when(~full, F.col("sum_score") + F.col(added)).when(counts, F.col("sum_score") - F.col("cap") + F.col(added)).otherwise(F.col("sum_score"))
    size = F.when(~full, F.col("n_counting") + 1).otherwise(F.col("n_counting"))
    return base.withColumn("new_score", F.floor(total / size).cast("bigint")).withColumn("counts", counts).withColumn("dropped", F.when(full & counts, F.col("cap")))


def spread_sample(rows: DataFrame, stratum: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """n rows spread over each stratum: positions floor(i * len / n); all rows of a smaller one."""
    w = Window.partitionBy(*stratum)
    p = rows.withColumn("_len", F.count("*").over(w)).withColumn("_pos", F.row_number().over(w.orderBy(*order)) - 1)
    # A position p is one of floor(i * len / n) exactly if the least i that reaches it does not overshoot.
    i = F.ceil(F.col("_pos") * n / F.col("_len"))
    hit = (F.col("_len") <= n) | ((i < n) & (F.floor(i * F.col("_len") / n) == F.col("_pos")))
    return p.where(hit).drop("_len", "_pos")
