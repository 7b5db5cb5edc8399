"""The given tables in the roles of results, ladders, pools and snapshots; with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANK_DATE = "2001-07-31"
#: Months of the eligibility window by group, and the category with an area allowance.
MONTHS, LONG_GROUP, LONG_MONTHS, AREA = 24, "MACHINERY", 36, "1"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as results of athletes (customers) in groups (market segments)."""
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("athlete"), F.col("c_mktsegment").alias("grp"),
        F.substring("o_orderpriority", 1, 1).alias("category"), (F.col("o_orderkey") % 16 + 1).cast("int").alias("place"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("mark_points"), F.col("o_orderdate").cast("date").alias("d"),
    )


RESULTS = """SELECT o_orderkey AS ord, o_custkey AS athlete, c_mktsegment AS grp, substr(o_orderpriority, 1, 1) AS category,
  (o_orderkey % 16 + 1)::INT AS place, floor(o_totalprice / 1000)::INT AS mark_points, o_orderdate::DATE AS d
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def window_months():
    return F.when(F.col("grp") == LONG_GROUP, LONG_MONTHS).otherwise(MONTHS)


MONTHS_SQL = f"CASE WHEN grp = '{LONG_GROUP}' THEN {LONG_MONTHS} ELSE {MONTHS} END"
START_SQL = f"(DATE '{RANK_DATE}' - to_months(({MONTHS_SQL})::INT))::DATE"
INSIDE_SQL = f"((d BETWEEN {START_SQL} AND DATE '{RANK_DATE}') OR (category = '{AREA}' AND d >= DATE '1999-01-01' AND d <= DATE '{RANK_DATE}'))"


def placing(spark: SparkSession, sf: str) -> DataFrame:
    """Placing tables by group, from how orders fall on categories and places: better places earn more."""
    r = results(spark, sf).where("place <= 8")
    n = r.groupBy("grp", "category", "place").agg(F.count("*").alias("n"))
    points = (9 - F.col("place")) * (12 - F.col("category").cast("int")) + F.col("n") % 5
    return n.select(F.col("grp").alias("table_no"), "category", F.col("place").cast("string").alias("place_key"), points.cast("int").alias("points"))


PLACING = f"""SELECT grp AS table_no, category, place::VARCHAR AS place_key, ((9 - place) * (12 - category::INT) + count(*) % 5)::INT AS points
  FROM ({RESULTS}) WHERE place <= 8 GROUP BY grp, category, place"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as results of athletes (suppliers); the round key repeats."""
    return t(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("athlete"), F.col("l_orderkey").alias("comp"), F.col("l_linenumber").alias("race"),
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("score"), F.floor("l_quantity").cast("int").alias("mark_points"),
        F.col("l_shipdate").cast("date").alias("d"), F.col("l_partkey").alias("part"),
    )


LINES = """SELECT l_suppkey AS athlete, l_orderkey AS comp, l_linenumber AS race, floor(l_extendedprice / 100)::INT AS score,
  floor(l_quantity)::INT AS mark_points, l_shipdate::DATE AS d, l_partkey AS part FROM lineitem"""


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as candidates of their region's event, with the nation as country; pos orders them without ties."""
    c, n = t(spark, sf, "customer"), t(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("n_regionkey").alias("event"), F.col("n_name").alias("country"), F.col("c_custkey").alias("athlete"), F.floor("c_acctbal").cast("bigint").alias("score"),
        F.when(F.col("c_mktsegment") == "BUILDING", "q1").otherwise("q4").alias("type"),
    )


POOL = """SELECT n_regionkey AS event, n_name AS country, c_custkey AS athlete, floor(c_acctbal)::BIGINT AS score,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'q1' ELSE 'q4' END AS type FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's state per day: sum of values in hundredths, number of events, and the day's rank."""
    from pyspark.sql import Window

    from ..operators.quota import rank_by_histogram

    e = t(spark, sf, "events").groupBy(F.col("user_id"), F.col("ts").cast("date").alias("period")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("score"), F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("qualified")
    )
    # Users of equal score are put in order among themselves; the rest of the place comes from counts of scores.
    tied = F.row_number().over(Window.partitionBy("period", "score").orderBy("user_id"))
    return rank_by_histogram(e, ["period"], "score", "place").withColumn("place", F.col("place") + tied - 1)


SNAPSHOTS = """SELECT user_id, ts::DATE AS period, sum(round(value * 100)::BIGINT)::BIGINT AS score, count(*) AS n, bool_or(event_type = 'purchase') AS qualified,
  row_number() OVER (PARTITION BY ts::DATE ORDER BY sum(round(value * 100)::BIGINT) DESC, user_id) AS place FROM events GROUP BY user_id, ts::DATE"""


def ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct retail prices as listed marks in hundredths: heights (even), of which higher ones earn more, and times (odd), of which lower ones do."""
    from pyspark.sql import Window

    p = t(spark, sf, "part").select(F.round(F.col("p_retailprice") * 100).cast("bigint").alias("mark_c")).distinct()
    p = p.withColumn("higher", F.col("mark_c") % 20 == 0).withColumn("slug", F.when(F.col("higher"), "even").otherwise("odd"))
    w = Window.partitionBy("slug").orderBy(F.when(F.col("higher"), F.col("mark_c")).otherwise(-F.col("mark_c")))
    return p.select("slug", "higher", "mark_c", F.row_number().over(w).cast("bigint").alias("points"))


LADDER = """SELECT slug, slug = 'even' AS higher, mark_c, row_number() OVER (PARTITION BY slug ORDER BY CASE slug WHEN 'even' THEN mark_c ELSE -mark_c END) AS points FROM
  (SELECT DISTINCT round(p_retailprice * 100)::BIGINT AS mark_c, CASE WHEN round(p_retailprice * 100)::BIGINT % 20 = 0 THEN 'even' ELSE 'odd' END AS slug FROM part)"""


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Marks to be scored: probe in quarters of a hundredth, probe_c in whole ones."""
    o = t(spark, sf, "orders")
    quarters = F.floor(89950 * 4 + F.col("o_totalprice") / 12.5)
    return o.select(F.col("o_orderkey").alias("probe_id"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("slug"), (quarters / 4).cast("decimal(14,2)").alias("probe"), F.floor(quarters / 4).cast("bigint").alias("probe_c"))


PROBES = """SELECT o_orderkey AS probe_id, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS slug, (floor(89950 * 4 + o_totalprice / 12.5::DOUBLE) / 4)::DECIMAL(14, 2) AS probe,
  floor(floor(89950 * 4 + o_totalprice / 12.5::DOUBLE) / 4)::BIGINT AS probe_c FROM orders"""
# Probes with the points of the best mark they reach: heights from below, times from above.
REACHED = f"""SELECT p.*, coalesce(l.points, 0)::BIGINT AS points FROM (SELECT * FROM ({PROBES}) WHERE slug = 'even') p ASOF LEFT JOIN ({LADDER}) l ON p.slug = l.slug AND p.probe >= l.mark_c
  UNION ALL SELECT p.*, coalesce(l.points, 0)::BIGINT FROM (SELECT * FROM ({PROBES}) WHERE slug = 'odd') p ASOF LEFT JOIN ({LADDER}) l ON p.slug = l.slug AND p.probe <= l.mark_c"""


def stages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rounds: user and day are the bucket."""
    race = F.create_map(*map(F.lit, ("purchase", " f1", "click", "sf2", "view", "Q1B", "signup", "H3", "error", "ER")))
    return t(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), race[F.col("event_type")].alias("race"))
