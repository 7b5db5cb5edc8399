"""Landed inputs as tables: JSON dimensions, pages, results, calculations, qualification lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import sort_key
from ..operators.changes import best_first

#: Groups whose window is longer than a year, in months.
LONG_WINDOWS = {"10000m": 18}
COUNTING_RESULTS = 5

#: Main events that are not timed.
HEIGHTS = ("High Jump", "Pole Vault")
DISTANCES = ("Long Jump", "Triple Jump", "Shot Put", "Discus Throw", "Hammer Throw", "Javelin Throw")

GROUPS = "groups ARRAY<STRUCT<label STRING, gender STRING, mainEvent STRING, similarEvents ARRAY<STRING>, slug STRING, disciplines ARRAY<STRING>>>"
LADDER = "slug STRING, gender STRING, column STRING, marks MAP<STRING, INT>"
ROUTES = "eventGroupTables MAP<STRING, STRUCT<final STRING, beforeFinal MAP<STRING, STRING>, byDiscipline MAP<STRING, STRUCT<final STRING>>>>"
PLACING = "tables MAP<STRING, STRUCT<title STRING, scores MAP<STRING, MAP<STRING, INT>>>>"


def mark_spec(main_event: Column) -> Column:
    """How a group's marks are read, compared and shown: kind, better_is_higher, decimals, unit."""
    spec = lambda kind, higher, unit: F.struct(F.lit(kind).alias("kind"), F.lit(higher).alias("better_is_higher"), F.lit(2).alias("decimals"), F.lit(unit).alias("unit"))
    return F.when(main_event.isin(*HEIGHTS), spec("height", True, "m")).when(main_event.isin(*DISTANCES), spec("distance", True, "m")).otherwise(spec("time", False, "s"))


def event_groups(spark: SparkSession, path: str) -> DataFrame:
    """One row per group, with its mark's spec, window_months and counting_results; fails on a null slug or empty disciplines."""
    g = spark.read.schema(GROUPS).option("multiLine", True).json(path).select(F.explode("groups").alias("g")).select("g.*")
    months = F.lit(12)
    for slug, m in LONG_WINDOWS.items():
        months = F.when(F.col("slug") == slug, m).otherwise(months)
    ok = F.col("slug").isNotNull() & (F.coalesce(F.size("disciplines"), F.lit(0)) > 0)
    g = g.withColumn("slug", F.when(ok, F.col("slug")).otherwise(F.raise_error(F.lit("event group without slug or disciplines"))))
    columns = ["slug", "label", F.when(F.col("gender") == "men", "men").otherwise("women").alias("gender"), F.col("mainEvent").alias("main_event"), F.col("similarEvents").alias("similar_events"), "disciplines"]
    return g.select(*columns, mark_spec(F.col("mainEvent")).alias("mark"), months.alias("window_months"), F.lit(COUNTING_RESULTS).alias("counting_results"))


def ladders(spark: SparkSession, path: str, as_mark, groups: DataFrame | None = None) -> DataFrame:
    """(slug, gender, mark_c, points) of all chunks; marks that do not parse are dropped. as_mark: text column to DECIMAL.

    Chunks in folders slug=.../gender=... (writers.ladder_chunks) are read only as far as a filter on these asks. With groups (event_groups) come
    `higher`, the group's direction, and `best`, the rank of each mark, best first; a group that is not listed is taken as timed.
    """
    rows = spark.read.schema(LADDER).option("multiLine", True).json(path).select("slug", "gender", F.explode("marks").alias("mark", "points"))
    rows = rows.withColumn("mark_c", F.round(as_mark(F.col("mark")) * 100).cast("bigint")).where("mark_c is not null").select("slug", "gender", "mark_c", "points")
    if groups is None:
        return rows
    of = groups.select("slug", "gender", F.col("mark.better_is_higher").alias("higher"))
    rows = rows.join(F.broadcast(of), ["slug", "gender"], "left").withColumn("higher", F.coalesce("higher", F.lit(False)))  # one row per event group
    return best_first(rows, ["slug", "gender"], sort_key(F.col("mark_c"), F.col("higher")))


def placing_tables(spark: SparkSession, path: str) -> DataFrame:
    """(table_no, category, place_key, points) from nested maps."""
    t = spark.read.schema(PLACING).option("multiLine", True).json(path).select(F.explode("tables").alias("table_no", "t"))
    t = t.select("table_no", F.explode("t.scores").alias("category", "by_place"))
    return t.select("table_no", "category", F.explode("by_place").alias("place_key", "points"))


def placing_routes(spark: SparkSession, path: str, groups: DataFrame) -> DataFrame:
    """(grp, round_kind, selector_kind, selector, table_no) of every group (slug), as scoring.placing_points reads them. A group that
    the file does not name takes the routes of `default`."""
    r = spark.read.schema(ROUTES).option("multiLine", True).json(path).select(F.explode("eventGroupTables").alias("named", "t"))
    names = groups.select(F.col("slug").alias("grp")).distinct()
    named = names.join(r, names["grp"] == r["named"], "left_semi")
    asked = named.withColumn("named", F.col("grp")).unionByName(names.join(named, "grp", "left_anti").withColumn("named", F.lit("default")))
    t = asked.join(F.broadcast(r), "named")  # a rule table of one row per event group
    none = F.lit(None).cast("string")
    final = t.select("grp", F.lit("final").alias("round_kind"), F.lit("group").alias("selector_kind"), none.alias("selector"), F.col("t.final").alias("table_no")).where("table_no is not null")
    before = t.select("grp", F.explode("t.beforeFinal").alias("selector", "table_no"))
    kind = F.when(F.col("selector").isin("min10", "max9"), "size").otherwise("category")
    before = before.select("grp", F.lit("before_final").alias("round_kind"), kind.alias("selector_kind"), "selector", "table_no")
    own = t.select("grp", F.explode("t.byDiscipline").alias("selector", "x")).select("grp", F.lit("final").alias("round_kind"), F.lit("discipline").alias("selector_kind"), "selector", F.col("x.final").alias("table_no"))
    return final.unionByName(before).unionByName(own)


def ranking_pages(pages: DataFrame) -> DataFrame:
    """All pages of each ranking as rows, dated by the first page. pages: slug, gender, page, rank_date, rankings array<struct>."""
    first = pages.where("page = 1").select("slug", "gender", F.col("rank_date").alias("_d"))
    rows = pages.select("slug", "gender", F.explode("rankings").alias("r"))
    return rows.join(first, ["slug", "gender"], "left").select("slug", "gender", F.col("_d").alias("rank_date"), "r.*")


def results_of_years(spark: SparkSession, path: str, years: Sequence[int], disciplines: Sequence[str] | None = None) -> DataFrame:
    """Results partitioned by year; the predicates reach partitions and the scan."""
    rows = spark.read.parquet(path).where(F.col("year").isin(*years))
    return rows if disciplines is None else rows.where(F.col("discipline").isin(*disciplines))


def counting_rows(calculations: DataFrame, key: Sequence[str]) -> DataFrame:
    """Nested counting results with their ordinal."""
    return calculations.select(*key, F.posexplode("results").alias("ord", "r")).select(*key, "ord", "r.*")


def qualification_rows(systems: DataFrame, key: Sequence[str], slug: str = "slug") -> DataFrame:
    """Qualifications in their list's order (pos); those without a slug go."""
    q = systems.select(*key, F.posexplode("qualifications").alias("pos", "q")).select(*key, "pos", "q.*")
    return q.where(F.col(slug).isNotNull())


def profile_results(profiles: DataFrame, key: Sequence[str]) -> DataFrame:
    """Disciplines and their results as flat rows that have a date and a mark; an odd shape gives no rows."""
    d = profiles.select(*key, F.explode_outer("disciplines").alias("d"))
    r = d.select(*key, F.col("d.name").alias("discipline"), F.explode_outer("d.results").alias("r")).select(*key, "discipline", "r.*")
    return r.where(F.col("date").isNotNull() & F.col("mark").isNotNull())


def page_of(rows: DataFrame, order, size: int, by: Sequence[str]) -> DataFrame:
    """Rows as landed pages of `size`, the inverse of ranking_pages."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("page", F.floor((n - 1) / size) + 1)
