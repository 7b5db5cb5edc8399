"""Points: ladders of marks, placing tables, comparisons over categories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import renamed, same, sliced

#: A ladder up to this number of rungs is broadcast; a longer one is shuffled.
SMALL_LADDER = 200_000


def _sized(df: DataFrame, rows: int = SMALL_LADDER) -> DataFrame:
    """Broadcast, where its size is checked; otherwise AQE decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _keys(ladder: DataFrame, group: Sequence[str], mark: str, points: str, higher: str | None) -> tuple[DataFrame, DataFrame]:
    """(rungs, directions). rungs: the group and _k, _q: marks as keys that grow as marks get better, with their most points. directions:
    the group and _sign. Rungs that lack a group, mark or points are none."""
    sound = ladder.where(reduce(and_, [F.col(c).isNotNull() for c in (*group, mark, points)]))
    sign = F.when(F.coalesce(F.col(higher), F.lit(True)), 1).otherwise(-1) if higher else F.lit(1)
    rungs = sound.groupBy(*group, (sign * F.col(mark)).cast("bigint").alias("_k")).agg(F.max(points).cast("bigint").alias("_q"))
    return rungs, sound.groupBy(*group).agg(F.max(sign).alias("_sign"))


def _placed(probes: DataFrame, directions: DataFrame, group: Sequence[str], probe: Column, broadcast: bool) -> DataFrame:
    """Adds _p, the probe's key: a height is rounded down and a time up to whole hundredths, as neither reaches more."""
    of = renamed(directions, group, "_g_")
    rows = probes.withColumn("_probe", probe)
    on = reduce(and_, [rows[c] == of[f"_g_{c}"] for c in group])
    return rows.join(F.broadcast(of) if broadcast else of, on, "left").withColumn("_p", F.floor(F.col("_sign") * F.col("_probe")).cast("bigint")).drop("_probe", "_sign", *[f"_g_{c}" for c in group])


def asof_points(probes: DataFrame, ladder: DataFrame, group: Sequence[str], probe: Column, mark: str = "mark_c", points: str = "points", higher: str | None = None) -> DataFrame:
    """Adds points: the most listed points of the marks that the probe reaches; the top beyond all, 0 if it reaches none.

    probe: hundredths, with fractions. higher: the ladder's column that says whether a group's higher marks are the better ones; without it
    all are. A probe without a group, of an unknown group or without a mark stays, with 0.

    A group's rungs are cut, by rank, into about as many buckets as each holds rungs. A probe finds its bucket among the buckets' first
    keys, which come with the group, and its rung within the bucket: two joins by equality, whatever lies between two marks. Ladders of over
    SMALL_LADDER rows go the way of asof_points_by_union.
    """
    if ladder.limit(SMALL_LADDER + 1).count() > SMALL_LADDER:
        return asof_points_by_union(probes, ladder, group, probe, mark, points, higher)
    rungs, directions = _keys(ladder, group, mark, points, higher)
    w = Window.partitionBy(*group)
    nth, best = F.row_number().over(w.orderBy("_k")) - 1, F.max("_q").over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    cut = rungs.select(*group, "_k", best.alias("_q"), F.floor(nth / F.ceil(F.sqrt(F.count("*").over(w)))).cast("int").alias("_b"))
    buckets = cut.groupBy(*group, "_b").agg(F.array_sort(F.collect_list(F.struct("_k", "_q"))).alias("_rungs"))
    firsts = buckets.groupBy(*group).agg(F.array_sort(F.collect_list(F.col("_rungs")[0]["_k"])).alias("_firsts"))
    reached = lambda keys: F.size(F.filter(keys, lambda k: k <= F.col("_p")))
    p = _placed(probes, firsts.join(directions, list(group)), group, probe, True)
    p = p.withColumn("_at", F.when(F.col("_p").isNotNull(), reached("_firsts") - 1)).drop("_firsts")
    held = renamed(buckets, group, "_g_")
    out = p.join(F.broadcast(held), reduce(and_, [p[c] == held[f"_g_{c}"] for c in group]) & (p["_at"] == held["_b"]), "left")
    rung = F.get("_rungs", F.size(F.filter("_rungs", lambda r: r["_k"] <= F.col("_p"))) - 1)
    return out.withColumn("points", F.coalesce(rung["_q"], F.lit(0))).drop("_p", "_at", "_b", "_rungs", *[f"_g_{c}" for c in group])


def _reached(rows: DataFrame, group: Sequence[str], key: str, value: str, name: str, below: bool = True, slices: int = 256) -> DataFrame:
    """Adds the greatest value at or below a row's key (or the least at or above it), within the group; null if there is none. Keys do not repeat.

    A group's keys are cut into slices of about equally many (sliced). A window sees one slice, and what the slices before it
    hold is carried over from one row per slice, so that a group of any size is spread over many tasks, however its keys lie.
    """
    best = F.max if below else F.min
    cut = sliced(rows, group, key, slices)
    near = Window.partitionBy(*group, "_slice").orderBy(key)
    near = near.rowsBetween(Window.unboundedPreceding, 0) if below else near.rowsBetween(0, Window.unboundedFollowing)
    far = Window.partitionBy(*group).orderBy(F.col("_slice") if below else F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*group, "_slice").agg(best(value).alias("_own")).withColumn("_far", best("_own").over(far)).drop("_own")
    before = renamed(before, [*group, "_slice"], "_c_")
    out = cut.withColumn(name, best(value).over(near))
    return out.join(before, same(out, before, [*group, "_slice"], "_c_")).withColumn(name, (F.greatest if below else F.least)(name, "_far")).drop("_slice", *before.columns)


def asof_points_by_union(probes: DataFrame, ladder: DataFrame, group: Sequence[str], probe: Column, mark: str = "mark_c", points: str = "points", higher: str | None = None) -> DataFrame:
    """The same rows as asof_points, for ladders too long to broadcast: distinct keys of probes and rungs are sorted together, slice by slice
    (_reached), and each probe fetches its key's points. A mark that very many probes share is looked up once."""
    rungs, directions = _keys(ladder, group, mark, points, higher)
    p = _placed(probes, directions, group, probe, False)
    asked = p.where("_p is not null").select(*group, F.col("_p").alias("_k"), F.lit(None).cast("bigint").alias("_q"))
    keys = rungs.unionByName(asked).groupBy(*group, "_k").agg(F.max("_q").alias("_q"))
    found = renamed(_reached(keys, group, "_k", "_q", "_points").select(*group, "_k", "_points"), group, "_g_")
    out = p.join(found, reduce(and_, [p[c] == found[f"_g_{c}"] for c in group]) & (p["_p"] == found["_k"]), "left")
    return out.withColumn("points", F.coalesce("_points", F.lit(0))).drop("_p", *found.columns)


def nearest_mark(scores: DataFrame, ladder: DataFrame, score: str, better_is_higher: bool = True, mark: str = "mark_c", points: str = "points") -> DataFrame:
    """Adds mark_c: the listed mark whose points are nearest; ties to the best mark.

    As-of both ways over the union of distinct scores and distinct points (_reached).
    """
    best = F.max if better_is_higher else F.min
    rungs = ladder.groupBy(F.col(points).cast("bigint").alias("_s")).agg(best(mark).alias("_mark"))
    rows = scores.withColumn("_row", F.struct(*scores.columns)).select(F.col(score).cast("bigint").alias("_s"), "_row")
    pair = F.struct(F.col("_s").alias("at"), F.col("_mark").alias("mark")).alias("_pair")
    rungs = rungs.select(F.lit(0).alias("_all"), "_s", pair)
    asked = rows.where("_s is not null").select(F.lit(0).alias("_all"), "_s", F.lit(None).cast(rungs.schema["_pair"].dataType).alias("_pair"), F.lit(True).alias("_asked"))
    both = asked.unionByName(rungs.withColumn("_asked", F.lit(False))).groupBy("_all", "_s").agg(F.max("_pair").alias("_pair"), F.max("_asked").alias("_asked"))
    both = _reached(_reached(both, ["_all"], "_s", "_pair", "_low"), ["_all"], "_s", "_pair", "_high", below=False).where("_asked")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["at"] - F.col("_s")).alias("d"), (-F.col(c)["mark"] if better_is_higher else F.col(c)["mark"]).alias("o"), F.col(c)["mark"].alias("m")))
    nearest = both.select("_s", F.least(far("_low"), far("_high"))["m"].alias("mark_c"))
    return rows.join(nearest, "_s", "left").select("_row.*", "mark_c")


def exact_points(probes: DataFrame, ladder: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, rows whose mark is not listed)."""
    return probes.join(ladder, list(on), "inner"), probes.join(ladder, list(on), "left_anti")


def placing_points(results: DataFrame, routes: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds placing_points, 0 where no cell exists.

    results: grp, discipline, round_kind, advanced, category, field_rule, place. routes: grp, round_kind,
    selector_kind (discipline, group, category, size), selector, table_no. For finals a discipline's route
    comes before the group's; before finals a category's before the field size's. tables: table_no,
    category, place_key, points; the key is `Q` for a row that advanced. Both are rule tables and small.
    """
    routes, tables = _sized(routes), _sized(tables)
    pick = lambda kind: routes.where(F.col("selector_kind") == kind).select("grp", "round_kind", F.col("selector").alias(f"_{kind}"), F.col("table_no").alias(f"_t_{kind}"))
    out = results
    for kind, own in (("discipline", "discipline"), ("category", "category"), ("size", "field_rule")):
        r = pick(kind).withColumnRenamed("grp", "_g").withColumnRenamed("round_kind", "_r")
        out = out.join(r, (out["grp"] == r["_g"]) & (out["round_kind"] == r["_r"]) & (out[own] == r[f"_{kind}"]), "left").drop("_g", "_r", f"_{kind}")
    r = pick("group").withColumnRenamed("grp", "_g").withColumnRenamed("round_kind", "_r")
    out = out.join(r, (out["grp"] == r["_g"]) & (out["round_kind"] == r["_r"]), "left").drop("_g", "_r", "_group")
    table = F.when(F.col("round_kind") == "final", F.coalesce("_t_discipline", "_t_group")).when(F.col("round_kind") == "before_final", F.coalesce("_t_category", "_t_size"))
    out = out.withColumn("_table", table).withColumn("_key", F.when((F.col("round_kind") == "before_final") & F.col("advanced"), "Q").otherwise(F.col("place").cast("string")))
    t = tables.select(F.col("table_no").alias("_tn"), F.col("category").alias("_tc"), F.col("place_key").alias("_tk"), F.col("points").alias("_tp"))
    out = out.join(t, (out["_table"] == t["_tn"]) & (out["category"] == t["_tc"]) & (out["_key"] == t["_tk"]), "left")
    return out.withColumn("placing_points", F.coalesce("_tp", F.lit(0))).drop("_table", "_key", "_tn", "_tc", "_tk", "_tp", "_t_discipline", "_t_category", "_t_size", "_t_group")


def category_comparison(scored: DataFrame, categories: DataFrame, tables: DataFrame, place: str = "place") -> DataFrame:
    """A row per scored row and category: mark points, placing points, total. Categories are a rule table: their codes are held as
    one array beside every row and exploded, so no cross join of data arises; the job fails on over SMALL_LADDER codes."""
    codes = categories.where("category is not null").agg(F.collect_set("category").alias("_codes"))
    codes = codes.select(F.lit(0).alias("_one"), F.when(F.size("_codes") <= SMALL_LADDER, F.col("_codes")).otherwise(F.raise_error(F.lit(f"over {SMALL_LADDER} categories: not a rule table"))).alias("_codes"))
    wide = scored.withColumn("_one", F.lit(0)).join(F.broadcast(codes), "_one").drop("_one").withColumn("category", F.explode("_codes")).drop("_codes")
    t = _sized(tables.select(F.col("category"), F.col("place_key").try_cast("int").alias(place), F.col("points").alias("_p")))
    out = wide.join(t, ["category", place], "left").withColumn("placing_points", F.coalesce("_p", F.lit(0))).drop("_p")
    return out.withColumn("total_score", F.col("mark_points") + F.col("placing_points"))


def score_series(compared: DataFrame, mark: str = "mark_points", prefix: str = "") -> DataFrame:
    """One row per mark, one column of scores per category that occurs (the prefix and its code)."""
    return compared.withColumn("_column", F.concat(F.lit(prefix), "category")).groupBy(mark).pivot("_column").agg(F.max("total_score"))


def scenario_scores(scenarios: DataFrame, ladder: DataFrame, routes: DataFrame, tables: DataFrame, slug: str = "slug", higher: str | None = None) -> DataFrame:
    """Adds mark_points, placing_points and score: what a mark and place in a final of a category would earn.

    scenarios: grp, slug (the ladder's group), mark_c, category, place. The round is a final and the discipline the group's own,
    so no discipline's route applies. routes and tables as in placing_points, higher as in asof_points.
    """
    s = asof_points(scenarios, ladder, [slug], F.col("mark_c"), higher=higher).withColumnRenamed("points", "mark_points")
    s = s.withColumns({"round_kind": F.lit("final"), "advanced": F.lit(False), "discipline": F.lit(None).cast("string"), "field_rule": F.lit(None).cast("string")})
    out = placing_points(s, routes, tables).drop("round_kind", "advanced", "discipline", "field_rule")
    return out.withColumn("score", F.col("mark_points") + F.col("placing_points"))
