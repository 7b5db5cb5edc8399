"""Data-quality checks and table extraction over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import extract as E
from ..operators.changes import agreement
from ..operators.counting import counting_order, in_disciplines
from ..operators.rounds import classify_rounds
from ..operators.scoring import asof_points, asof_points_by_union, placing_points
from .bindings import INSIDE_SQL, PLACING, REACHED, RESULTS, SNAPSHOTS, ladder, placing, probes, results, snapshots, t
from .ranking_queries import COUNTING, SCORED, TABLES, _counting, _inside, _placing_with_q, _routes, routed, scored
from .registry import query


@query("""WITH e AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1), g AS (SELECT o_custkey AS k, count(*) AS got FROM orders WHERE o_totalprice > 2000 GROUP BY 1)
SELECT k, v, got FROM e LEFT JOIN g USING (k) WHERE v IS DISTINCT FROM got""")
def q1_anchors(spark, sf):
    o = t(spark, sf, "orders")
    n = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    return K.anchors(n(o), n(o.where("o_totalprice > 2000")), ["k"], "v")


_UNEVEN = f"SELECT table_no, category, place_key, CASE WHEN points % 3 = 0 THEN points + 20 ELSE points END AS points FROM ({PLACING})"


@query(f"SELECT table_no, category, place_key, points FROM (SELECT *, lag(points) OVER (PARTITION BY table_no, category ORDER BY place_key::INT) AS before FROM ({_UNEVEN})) WHERE points > before")
def q2_not_monotone(spark, sf):
    """Placing tables of which some points are raised, so that there is something to find."""
    points = F.when(F.col("points") % 3 == 0, F.col("points") + 20).otherwise(F.col("points"))
    p = placing(spark, sf).withColumn("points", points).withColumn("n", F.col("place_key").cast("int"))
    return K.not_monotone(p, ["table_no", "category"], "n", "points").select("table_no", "category", "place_key", "points")


@query("""SELECT 'priced' AS rule, count(*) FILTER (NOT coalesce(o_totalprice > 5000, false)) AS violations FROM orders UNION ALL SELECT 'named', count(*) FILTER (NOT coalesce(o_orderpriority IS NOT NULL, false)) FROM orders
UNION ALL SELECT 'closed', count(*) FILTER (NOT coalesce(o_orderstatus = 'F', false)) FROM orders""")
def q3_rules(spark, sf):
    return K.rule_violations(t(spark, sf, "orders"), {"priced": "o_totalprice > 5000", "named": "o_orderpriority is not null", "closed": "o_orderstatus = 'F'"})


@query("""(SELECT p_brand, p_size, 'missing' AS side FROM (SELECT p_brand, p_size FROM part WHERE p_type = 'SMALL' EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_type = 'ECONOMY'))
UNION ALL (SELECT p_brand, p_size, 'stale' FROM (SELECT p_brand, p_size FROM part WHERE p_type = 'ECONOMY' EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_type = 'SMALL'))""")
def u3_q4_set_agreement(spark, sf):
    p = t(spark, sf, "part")
    side = lambda k: p.where(F.col("p_type") == k).select("p_brand", "p_size")
    return agreement(side("SMALL"), side("ECONOMY"))


# The official points of a probe: the ladder's, but 10 more in each seventh (a wind's adjustment) and 40 more in each fiftieth row.
_OFFICIAL = f"SELECT *, points + CASE WHEN probe_id % 50 = 0 THEN 40 WHEN probe_id % 7 = 0 THEN 10 ELSE 0 END AS official FROM ({REACHED})"


@query(f"""SELECT slug, CASE WHEN official = points THEN 'exact' WHEN abs(official - points) <= CASE WHEN probe_id % 7 = 0 THEN 20 ELSE 0 END THEN 'tolerated' ELSE 'error' END AS class, count(*) AS n FROM ({_OFFICIAL}) GROUP BY ALL""")
def q5_replay_classes(spark, sf):
    """Marks are scored again from the ladder (J3) and compared with the points they were given; wind explains some differences."""
    listed = ladder(spark, sf)
    given = asof_points_by_union(probes(spark, sf), listed, ["slug"], F.col("probe"), higher="higher").withColumnRenamed("points", "official")
    given = given.withColumn("official", F.col("official") + F.when(F.col("probe_id") % 50 == 0, 40).when(F.col("probe_id") % 7 == 0, 10).otherwise(0))
    rows = asof_points(given, listed, ["slug"], F.col("probe"), higher="higher").withColumn("tolerance", F.when(F.col("probe_id") % 7 == 0, 20).otherwise(0))
    return K.replay_classes(rows, "points", "official", "tolerance", ["slug"])


# The official counting sets: as ranked, but for each tenth athlete, whose best result was passed over.
_GIVEN = f"""SELECT athlete, grp, ord FROM (SELECT *, row_number() OVER (PARTITION BY athlete, grp ORDER BY total_score DESC, mark_points DESC, d DESC, ord) AS n FROM ({SCORED}) WHERE {INSIDE_SQL}) WHERE n BETWEEN 1 + (athlete % 10 = 0)::INT AND 5 + (athlete % 10 = 0)::INT"""


@query(f"""WITH a AS (SELECT athlete, grp, list_sort(list(ord)) AS l FROM ({COUNTING}) GROUP BY ALL), b AS (SELECT athlete, grp, list_sort(list(ord)) AS l FROM ({_GIVEN}) GROUP BY ALL)
SELECT coalesce(a.athlete, b.athlete) AS athlete, coalesce(a.grp, b.grp) AS grp, a.l IS NOT DISTINCT FROM b.l AS same FROM a FULL JOIN b ON a.athlete = b.athlete AND a.grp = b.grp""")
def q6_same_sets(spark, sf):
    """Results are placed, scored, put in the window and counted anew, and the sets compared with the official ones."""
    shift = (F.col("athlete") % 10 == 0).cast("int")
    n = F.row_number().over(Window.partitionBy("athlete", "grp").orderBy(*counting_order("total_score", "mark_points", "d", "ord")))
    given = scored(spark, sf).where(_inside()).withColumn("n", n).where((F.col("n") >= 1 + shift) & (F.col("n") <= 5 + shift))
    return K.same_sets(_counting(spark, sf), given, ["athlete", "grp"], "ord")


# The replay's own side: listed disciplines, rounds from race codes, placing points by the round's route, a score.
_RACED = f"""SELECT r.*, o_orderpriority AS discipline, CASE WHEN grp IN ('BUILDING', 'MACHINERY') THEN 'min10' ELSE 'max9' END AS field_rule, ord % 3 = 0 AS final, CASE ord % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 END AS stage
  FROM ({RESULTS}) r JOIN orders ON o_orderkey = ord WHERE o_orderpriority <> '4-NOT SPECIFIED'"""
_ROUNDED = f"""SELECT *, CASE WHEN final THEN 'final' WHEN stage = max(stage) OVER w THEN 'before_final' ELSE 'other' END AS round_kind, bool_or(final) OVER w AND NOT final AS advanced FROM ({_RACED}) WINDOW w AS (PARTITION BY athlete, grp, category)"""
_REPLAYED = f"""SELECT s.*, (s.mark_points + coalesce(p.points, 0))::BIGINT AS score FROM ({routed(_ROUNDED)}) s LEFT JOIN ({TABLES}) p ON p.table_no = s.table_no AND p.category = s.category
  AND p.place_key = CASE WHEN round_kind = 'before_final' AND advanced THEN 'Q' ELSE s.place::VARCHAR END"""
# The published side: as ours, but for the planted cases.
_PUBLISHED = f"""SELECT *, (score + CASE WHEN athlete % 7 = 3 AND nth = lowest THEN 10 ELSE 0 END)::BIGINT AS official, CASE WHEN athlete % 11 = 5 AND nth = lowest THEN DATE '1990-01-01' ELSE d END AS shown
  FROM (SELECT *, min(nth) OVER (PARTITION BY athlete, grp) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY athlete, grp ORDER BY score DESC, mark_points DESC, d DESC, ord) AS nth, count(*) OVER (PARTITION BY athlete, grp) AS has FROM ({_REPLAYED}) WHERE {INSIDE_SQL})
    WHERE nth BETWEEN 1 + (athlete % 10 = 0 AND has > 5)::INT AND 5 + (athlete % 10 = 0 AND has > 5)::INT)"""


@query(f"""SELECT athlete, grp, bool_and(official = score) AS scores, bool_and({INSIDE_SQL.replace('d BETWEEN', 'shown BETWEEN').replace('d >=', 'shown >=').replace('d <=', 'shown <=')}) AS window, athlete % 13 <> 6 AS average, min(nth) = 1 AS selection
FROM ({_PUBLISHED}) GROUP BY athlete, grp""".replace(" AS window,", ' AS "window",'))
def q6_counting_replay(spark, sf):
    """Q6: published calculations, held apart as nested rows, replayed through J1, W1, J2, P9, W4 and A1; a score, a day, an average and a choice are off in some."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("discipline"))
    segments = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("grp")).distinct()
    listed = segments.withColumns({"gender": F.lit("x"), "disciplines": F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")))}).withColumnRenamed("grp", "group")
    rows = in_disciplines(results(spark, sf).join(o, "ord").withColumn("gender", F.lit("x")), listed).where("grp = group").drop("gender", "group")
    rows = rows.withColumn("race", F.element_at(F.array(*map(F.lit, ("F1", "SF2", "H3"))), (F.col("ord") % 3 + 1).cast("int")))
    rows = classify_rounds(rows, ["athlete", "grp", "category"]).withColumn("field_rule", F.when(F.col("grp").isin("BUILDING", "MACHINERY"), "min10").otherwise("max9"))
    ours = placing_points(rows, _routes(spark, sf), _placing_with_q(spark, sf)).withColumn("score", (F.col("mark_points") + F.col("placing_points")).cast("bigint"))
    by = Window.partitionBy("athlete", "grp")
    order = counting_order("score", "mark_points", "d", "ord")
    nth = ours.where(_inside()).withColumns({"nth": F.row_number().over(by.orderBy(*order)), "has": F.count("*").over(by)})
    later = ((F.col("athlete") % 10 == 0) & (F.col("has") > 5)).cast("int")
    some = nth.where(F.col("nth").between(1 + later, 5 + later)).withColumn("first", F.col("nth") == 1 + later)
    official = (F.col("score") + F.when((F.col("athlete") % 7 == 3) & F.col("first"), 10).otherwise(0)).alias("official")
    shown = F.when((F.col("athlete") % 11 == 5) & F.col("first"), F.lit("1990-01-01").cast("date")).otherwise(F.col("d")).alias("d")
    published = some.groupBy("athlete", "grp").agg(F.array_sort(F.collect_list(F.struct("ord", official, shown, "category"))).alias("results"))
    mean = F.floor(F.aggregate("results", F.lit(0).cast("bigint"), lambda a, r: a + r["official"]) / F.size("results"))
    published = published.withColumn("published", mean + F.when(F.col("athlete") % 13 == 6, 1).otherwise(0))
    return K.counting_replay(ours, published, ["athlete", "grp"], ["ord"], "score", _inside(), order)


@query("""SELECT n_nationkey AS k, coalesce(n, 0)::BIGINT AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE coalesce(n, 0) <> 1""")
def q7_found_once(spark, sf):
    return K.found_once(t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), "k")


@query(f"""SELECT user_id, period, last_value(CASE WHEN qualified THEN place END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS label FROM ({SNAPSHOTS})""")
def w14_carried_down(spark, sf):
    s = snapshots(spark, sf).withColumn("label", F.when(F.col("qualified"), F.col("place"))).select("user_id", "period", "label")
    return E.carried_down(s, "user_id", "period", "label")


@query(f"""WITH s AS (SELECT user_id, period, CASE WHEN qualified OR row_number() OVER (PARTITION BY user_id ORDER BY period) = 1 THEN place END AS p, row_number() OVER (PARTITION BY user_id ORDER BY period) AS n FROM ({SNAPSHOTS})),
  k AS (SELECT *, last_value(CASE WHEN p IS NOT NULL THEN n END IGNORE NULLS) OVER w AS ln, last_value(p IGNORE NULLS) OVER w AS lp FROM s WINDOW w AS (PARTITION BY user_id ORDER BY period ROWS UNBOUNDED PRECEDING))
SELECT user_id, period, coalesce(p, lp + n - ln) AS place FROM k""")
def w15_inferred_places(spark, sf):
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("period")) == 1
    s = snapshots(spark, sf).select("user_id", "period", F.when(F.col("qualified") | first, F.col("place")).alias("place"))
    return E.inferred_places(s, "user_id", "period", "place")


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Men''s ' ELSE 'Women''s ' END || p_brand AS label, CASE WHEN p_partkey % 2 = 0 THEN 'men' ELSE 'women' END AS gender, p_type AS main_event, replace(p_name, ' ', ';') AS similar_events FROM part""")
def x3_tidy_groups(spark, sf):
    """Parts as rows of a table of groups, with blanks, doubled commas and rows without a label."""
    part = t(spark, sf, "part")
    label = F.concat(F.when(F.col("p_partkey") % 2 == 0, " Men's ").otherwise("Women's "), F.col("p_brand"))
    rows = part.select(label.alias("label"), F.concat(F.lit(" "), F.col("p_type")).alias("main"), F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , , ")), F.lit(",")).alias("similar"))
    rows = rows.unionByName(part.select(F.lit(" ").alias("label"), F.lit("x").alias("main"), F.lit(None).cast("string").alias("similar")))
    return E.tidy_groups(rows).withColumn("similar_events", F.array_join("similar_events", ";"))


@query("SELECT DISTINCT p_size::VARCHAR AS code, p_type AS details FROM part")
def x3_tidy_categories(spark, sf):
    part = t(spark, sf, "part").select(F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("code"), F.concat(F.col("p_type"), F.lit(" ")).alias("details"))
    return E.tidy_categories(part.unionByName(part.withColumn("code", F.lit("  ")))).distinct()


@query("""SELECT DISTINCT w AS wind, p AS points FROM (SELECT (p_size % 8)::DOUBLE / 4 AS w, -(p_size % 8) AS p FROM part UNION ALL SELECT CASE WHEN p_size % 8 = 0 THEN 0 ELSE -(p_size % 8)::DOUBLE / 4 END, p_size % 8 FROM part WHERE p_size % 5 > 0)""")
def x3_tidy_wind(spark, sf):
    """Tail and head winds in two pairs of cells, with units, signs, a signed zero and blanks."""
    n = F.col("p_size") % 8
    speed = lambda sign: F.concat(F.lit(sign), (n / 4).cast("string"), F.lit(" m/s"))
    cells = F.array(speed("+"), F.concat(F.lit("-"), n.cast("string"), F.lit(".0 pts")), F.when(F.col("p_size") % 5 > 0, speed("-")).otherwise(" "), F.concat(F.lit("+"), n.cast("string"), F.lit(" pts")))
    return E.tidy_wind(t(spark, sf, "part").select(cells.alias("cells")))


_PAGE = "(SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey, floor(o_totalprice)::INT AS score, o_orderkey % 977 AS a, o_orderkey % 7 = 0 AS dash, o_orderkey % 11 = 0 AS odd FROM orders)"


@query(f"""SELECT doc::BIGINT AS doc, 'MEN' AS section, '3000m SC' AS "column", a::VARCHAR AS mark, arg_min(score, line) AS score FROM {_PAGE} WHERE NOT dash AND NOT odd GROUP BY doc, a""")
def x1_page_tables(spark, sf):
    """Each customer's orders as a landed page: a running head, a header, lines of score and mark, some `-` and some too wide."""
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.floor("o_totalprice").cast("int").cast("string").alias("score"), (F.col("o_orderkey") % 977).cast("string").alias("a"))
    cell = F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(F.col("a"))
    row = F.concat(F.col("score"), F.lit("  "), cell, F.when(F.col("o_orderkey") % 11 == 0, " wide").otherwise(""))
    pages = o.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("l"))
    text = F.concat(F.lit("Steeplechase men\nPoints 3000m SC\n"), F.array_join(F.transform("l", lambda x: x["row"]), "\n"))
    return E.table_rows(pages.select("doc", F.lit(1).alias("page"), text.alias("text")))


@query("""WITH b AS (SELECT n_regionkey AS "table", row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, n_nationkey FROM nation)
SELECT "table", CASE row WHEN 5 THEN 'Q' WHEN 4 THEN unnest(['4', '5', '6']) ELSE row::VARCHAR END AS place_key, 'A' AS category, (100 - n_nationkey)::INT AS points FROM b WHERE row <> 4
UNION ALL SELECT "table", unnest(['4', '5', '6']), 'A', (100 - n_nationkey)::INT FROM b WHERE row = 4""".replace("CASE row WHEN 5 THEN 'Q' WHEN 4 THEN unnest(['4', '5', '6']) ELSE row::VARCHAR END", "CASE row WHEN 5 THEN 'Q' ELSE row::VARCHAR END"))
def x2_placing_cells(spark, sf):
    """Nations as rows of placing tables: `1st`, a blank (the place before plus one), `3rd *`, a range with a dash, and `Q or q to Final`."""
    from pyspark.sql import Window

    n = t(spark, sf, "nation").withColumn("row", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    label = F.element_at(F.array(*map(F.lit, ("1st", "", "3rd *", "4\u20136th", "Q or q to Final"))), F.col("row"))
    cells = F.array(F.struct(F.lit("A").alias("category"), F.concat((100 - F.col("n_nationkey")).cast("string"), F.lit("*")).alias("value")), F.struct(F.lit("B").alias("category"), F.lit(" ").alias("value")))
    return E.placing_cells(n.select(F.col("n_regionkey").alias("table"), "row", label.alias("label"), cells.alias("cells")))
