"""Differences between snapshots, their composition, and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place_changes(prev: DataFrame, cur: DataFrame, key: Sequence[str], scopes: Sequence[str]) -> DataFrame:
    """(key, scope, from_value, to_value, direction): one row per scope whose place is known on both sides and differs."""
    p = prev.select(*key, *[F.col(s).alias(f"_p_{s}") for s in scopes])
    c = cur.select(*key, *[F.col(s).alias(f"_c_{s}") for s in scopes])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"_p_{s}").cast("bigint").alias("from_value"), F.col(f"_c_{s}").cast("bigint").alias("to_value")) for s in scopes]))
    out = p.join(c, list(key)).select(*key, rows.alias("x")).select(*key, "x.*").where("from_value <> to_value")
    return out.withColumn("direction", F.when(F.col("to_value") < F.col("from_value"), "up").otherwise("down"))


def score_changes(prev: DataFrame, cur: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """(key, from_value, to_value, delta) of differing scores, delta to two places."""
    d = lambda df, n: df.select(*key, F.col(score).cast("decimal(18,4)").alias(n))
    out = d(prev, "from_value").join(d(cur, "to_value"), list(key)).where("from_value <> to_value")
    return out.withColumn("delta", F.round(F.col("to_value") - F.col("from_value"), 2))


def flips(prev: DataFrame, cur: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    out = prev.select(*key, F.col(flag).alias("from_value")).join(cur.select(*key, F.col(flag).alias("to_value")), list(key))
    return out.where("from_value <> to_value")


def gated(prev: DataFrame, cur: DataFrame, key: Sequence[str], period: str) -> DataFrame:
    """Current rows that may report ranking changes: there is a previous row, of another period."""
    p = prev.select(*key, F.col(period).alias("_was"))
    return cur.join(p, list(key)).where(F.col("_was") != F.col(period)).drop("_was")


def composed(first: DataFrame, second: DataFrame, key: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """A to B, then B to C, is A to C; what returns to its start vanishes, as does a change on both sides with an unknown end;
    one-sided changes pass. The columns `carried` (such as an introduction that is still owed) are the first side's, else the second's."""
    a = first.select(*key, F.lit(True).alias("_a"), F.col("from_value").alias("_af"), F.col("to_value").alias("_at"), *[F.col(c).alias(f"_a_{c}") for c in carried])
    b = second.select(*key, F.lit(True).alias("_b"), F.col("from_value").alias("_bf"), F.col("to_value").alias("_bt"), *[F.col(c).alias(f"_b_{c}") for c in carried])
    both = a.join(b, list(key), "full_outer")
    stays = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_af") != F.col("_bt"))
    one = lambda x, y, own: F.when(F.col(own).isNull(), F.col(y)).otherwise(F.col(x))
    return both.where(stays).select(*key, one("_af", "_bf", "_a").alias("from_value"), one("_bt", "_at", "_b").alias("to_value"), *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in carried])


def composed_chain(steps: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The same for contiguous chains of any length: first from, last to."""
    out = steps.groupBy(*key).agg(F.min_by("from_value", seq).alias("from_value"), F.max_by("to_value", seq).alias("to_value"), F.count("*").alias("n_steps"))
    return out.where("not (from_value <=> to_value)")


def new_rows(cur: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key was not there; rows that repeat stay."""
    return cur.join(seen.select(*key).distinct(), list(key), "left_anti")


def first_wins(a: DataFrame, b: DataFrame, key: Sequence[str], ord_: str) -> DataFrame:
    """Union of two sides; of rows with one key, the first of the first side stays."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*key).orderBy("_side", ord_)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def agreement(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted: side is missing or stale."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("stale")))


def last_name(rows: DataFrame, key: Sequence[str], name: str, ord_: str) -> DataFrame:
    """One row per key, with the last name seen."""
    return rows.groupBy(*key).agg(F.max_by(name, ord_).alias(name))


def season_best(results: DataFrame, key: Sequence[str], text: str, value: str, better_is_higher: bool, ord_: str) -> DataFrame:
    """The text of the best mark, the first on ties; rows without a number are skipped."""
    k = F.col(value) if better_is_higher else -F.col(value)
    return results.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(text, F.struct(k, -F.col(ord_))).alias("best"))


def within_limit(rows: DataFrame, key: Sequence[str], order: Sequence[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows within the first `limit` of a key, those beyond)."""
    w = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return w.where(F.col("_n") <= limit).drop("_n"), w.where(F.col("_n") > limit).drop("_n")


def digest(items: DataFrame, user: str, athlete: str, line: str, ord_: Sequence[str]) -> DataFrame:
    """(user, n_athletes, n_items, body): one row per user who has items, lines in order."""
    s = F.struct(*ord_, line)
    return items.groupBy(user).agg(
        F.count_distinct(athlete).alias("n_athletes"), F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x[line]), "\n").alias("body")
    )


def introductions(favorites: DataFrame, standings: DataFrame, athlete: str) -> DataFrame:
    """Favorites not introduced yet whose athlete's ranking moved on: a summary that takes the place of changes."""
    return favorites.where(~F.coalesce("intro_sent", F.lit(False))).join(standings.where("rank_advanced"), athlete)


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], kept_if_null: Sequence[str]) -> DataFrame:
    """The newer of each key; the named columns keep their old value where the new one is null (not read)."""
    cols = [c for c in new.columns if c not in key]
    o = old.select(*key, F.lit(True).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(*key, F.lit(True).alias("_n"), *cols)
    pick = lambda c: F.when(F.col("_n").isNull(), F.col(f"_o_{c}")).otherwise(F.coalesce(c, f"_o_{c}") if c in kept_if_null else F.col(c)).alias(c)
    return o.join(n, list(key), "full_outer").select(*key, *[pick(c) for c in cols])


def newest_first(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(key, values): a key's values, newest first."""
    listed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, value)), False).alias("_l"))
    return listed.select(*key, F.transform("_l", lambda x: x[value]).alias("values"))


def period_delta(snapshots: DataFrame, key: Sequence[str], period: str, values: Sequence[str]) -> DataFrame:
    """(key, period, <value>_delta...): each value less the one of the period before; null in the first."""
    w = Window.partitionBy(*key).orderBy(period)
    return snapshots.select(*key, period, *[(F.col(v) - F.lag(v).over(w)).alias(f"{v}_delta") for v in values])


def best_first(rows: DataFrame, by: Sequence[str], key: Column, name: str = "best") -> DataFrame:
    """Adds the rank of each row by a key that grows as marks get better (exprs.sort_key)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(key.desc())).cast("bigint"))


def run_report(deliveries: DataFrame) -> DataFrame:
    """One row about a run from (user_id, athlete, resolved, status, period): users, athletes, resolved and skipped athletes, sent and
    failed deliveries, and rank_dates, the newest period of each athlete's group (a map)."""
    distinct = lambda cond: F.count_distinct(F.when(cond, F.col("athlete")))
    out = deliveries.agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("athlete").alias("athletes"), distinct(F.col("resolved")).alias("resolved"), distinct(~F.col("resolved")).alias("skipped"),
        F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "error").alias("failed"),
        F.array_sort(F.collect_set(F.when(F.col("resolved"), F.struct("grp", "period")))).alias("_d"),
    )
    newest = F.filter("_d", lambda x, i: (i == F.size("_d") - 1) | (F.get("_d", i + 1)["grp"] != x["grp"]))
    return out.withColumn("rank_dates", F.map_from_entries(newest)).drop("_d")


def unsent(candidates: DataFrame, log: DataFrame, key: Sequence[str]) -> DataFrame:
    """Deliveries not sent yet: a sent row blocks, an error row does not."""
    return candidates.join(log.where("status = 'sent'").select(*key).distinct(), list(key), "left_anti")


def live_outbox(outbox: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The latest entry of each (user, kind), unless it was left alone for more than `days`."""
    w = Window.partitionBy("user_id", "kind").orderBy(F.col("updated_at").desc())
    return outbox.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").where(F.col("updated_at") >= now - F.make_interval(days=F.lit(days)))
