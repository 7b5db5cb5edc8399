"""Data quality: every check returns its violations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchors(expected: DataFrame, actual: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Expected rows whose key is missing or has another value."""
    got = actual.select(*key, F.col(value).alias("got"))
    return expected.join(got, list(key), "left").where(~F.col("got").eqNullSafe(F.col(value)))


def not_monotone(tables: DataFrame, by: Sequence[str], order: str, points: str) -> DataFrame:
    """Rows that score more than the place before them."""
    w = Window.partitionBy(*by).orderBy(order)
    return tables.withColumn("before", F.lag(points).over(w)).where(F.col(points) > F.col("before"))


def rule_violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations): how many rows break each SQL condition that must hold; unknown is a breach."""
    counts = rows.agg(*[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "violations"))


def replay_classes(replayed: DataFrame, recomputed: str, official: str, tolerance: str, by: Sequence[str] = ()) -> DataFrame:
    """(class, n): exact, tolerated (the difference is within `tolerance`, a column) or error."""
    diff = F.abs(F.col(recomputed) - F.col(official))
    kind = F.when(diff == 0, "exact").when(diff <= F.col(tolerance), "tolerated").otherwise("error")
    return replayed.groupBy(*by, kind.alias("class")).agg(F.count("*").alias("n"))


def table_statistics(tables: DataFrame, by: Sequence[str], mark: str, points: str) -> DataFrame:
    """(by, n, lowest, top): entries, least mark and most points of each table."""
    return tables.groupBy(*by).agg(F.count("*").alias("n"), F.min(mark).alias("lowest"), F.max(points).alias("top"))


def same_sets(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, same): whether both sides hold the same values, repeats counted."""
    g = lambda df, n: df.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias(n))
    return g(a, "_a").join(g(b, "_b"), list(key), "full_outer").select(*key, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def counting_replay(scored: DataFrame, calculations: DataFrame, key: Sequence[str], result_key: Sequence[str], score: str, inside: Column, order: Sequence[Column]) -> DataFrame:
    """(key, scores, window, average, selection): what of each published calculation the results reproduce.

    scored: results with our score and what `inside` and `order` read. calculations: key, published, and results, an array of structs of result_key, official (its score) and
    what `inside` reads. scores: every official result is found, with its score; window: all lie inside; average: published is the floor of the mean of the
    official scores; selection: as many of our best results inside the window are the same ones.
    """
    official = calculations.select(*key, "published", F.explode("results").alias("_r")).select(*key, "published", "_r.*")
    ours = scored.select(*key, *result_key, F.col(score).alias("_ours"))
    same = F.coalesce(F.col("_ours") == F.col("official"), F.lit(False))
    told = official.join(ours, [*key, *result_key], "left").groupBy(*key).agg(
        F.bool_and(same).alias("scores"), F.bool_and(F.coalesce(inside, F.lit(False))).alias("window"), (F.floor(F.avg("official")) == F.max("published")).alias("average"),
        F.array_sort(F.collect_list(F.struct(*result_key))).alias("_theirs"), F.count("*").alias("_n"),
    )
    most = told.select(*key, "_n")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    chosen = scored.where(inside).join(most, list(key)).withColumn("_nth", nth).where("_nth <= _n").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*result_key))).alias("_chosen"))
    return told.join(chosen, list(key), "left").select(*key, "scores", "window", "average", F.col("_theirs").eqNullSafe(F.col("_chosen")).alias("selection"))


def found_once(found: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """(key, n): required keys that were not found exactly once."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    return required.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def or_fail(violations: DataFrame, what: str) -> None:
    """Ends the job if there is any violation; shows the first few."""
    if some := violations.take(5):
        raise ValueError(f"{what}: {some}")
