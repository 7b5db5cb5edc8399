"""Ranking: eligibility, placing and ladder points, counting results, substitutes, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import counting as C
from ..operators import rounds, scoring
from ..operators.quota import rank_by_histogram
from .bindings import AREA, INSIDE_SQL, LADDER, LINES, PLACING, PROBES, RANK_DATE, REACHED, RESULTS, ladder, lines, placing, probes, results, shared_folder, stages, t, window_months
from .registry import query


def _inside():
    end = F.lit(RANK_DATE).cast("date")
    return X.eligible(F.col("d"), F.col("category"), X.window_start(end, window_months()), end, AREA)


def scored(spark, sf) -> DataFrame:
    """Results with placing points of their group's table and a total."""
    r = results(spark, sf).withColumn("round_kind", F.lit("final")).withColumn("advanced", F.lit(False)).withColumn("discipline", F.col("grp")).withColumn("field_rule", F.lit(None).cast("string"))
    p = placing(spark, sf)
    routes = p.select("table_no").distinct().select(F.col("table_no").alias("grp"), F.lit("final").alias("round_kind"), F.lit("group").alias("selector_kind"), F.lit(None).cast("string").alias("selector"), "table_no")
    out = scoring.placing_points(r, routes, p)
    return out.select("ord", "athlete", "grp", "category", "place", "mark_points", "d", "placing_points", (F.col("mark_points") + F.col("placing_points")).alias("total_score"))


SCORED = f"""SELECT r.*, coalesce(p.points, 0)::INT AS placing_points, (r.mark_points + coalesce(p.points, 0))::INT AS total_score
  FROM ({RESULTS}) r LEFT JOIN ({PLACING}) p ON p.table_no = r.grp AND p.category = r.category AND p.place_key = r.place::VARCHAR"""
COUNTING = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY athlete, grp ORDER BY total_score DESC, mark_points DESC, d DESC, ord) AS counting_rank
  FROM ({SCORED}) WHERE {INSIDE_SQL}) WHERE counting_rank <= 5"""
RANKED = f"""SELECT athlete, grp, floor(avg(total_score))::BIGINT AS ranking_score, count(*) AS n_counting, min(total_score)::BIGINT AS cap, sum(total_score)::BIGINT AS sum_score FROM ({COUNTING}) GROUP BY athlete, grp"""


def _counting(spark, sf) -> DataFrame:
    return C.top_n(scored(spark, sf).where(_inside()), ["athlete", "grp"], C.counting_order("total_score", "mark_points", "d", "ord"))


def _ranked(spark, sf) -> DataFrame:
    return C.ranking_score(_counting(spark, sf), ["athlete", "grp"], "total_score")


@query(f"SELECT *, rank() OVER (PARTITION BY grp ORDER BY ranking_score DESC) AS place FROM ({RANKED})")
def flagship_ranking(spark, sf):
    """Results to ranking scores and places, for all athletes."""
    return rank_by_histogram(_ranked(spark, sf), ["grp"], "ranking_score", "place")


@query(f"SELECT ord, placing_points, total_score FROM ({SCORED})")
def j2_placing_points(spark, sf):
    return scored(spark, sf).select("ord", "placing_points", "total_score")


# Points of the row that advanced ("Q") besides the places'.
TABLES = f"SELECT * FROM ({PLACING}) UNION ALL SELECT table_no, category, 'Q', max(points) + 1 FROM ({PLACING}) GROUP BY table_no, category"
_STAGED = f"""SELECT r.*, o_orderpriority AS discipline, ['final', 'before_final', 'other'][(ord % 3 + 1)::INT] AS round_kind, ord % 3 = 1 AND ord % 5 = 0 AS advanced, CASE WHEN grp IN ('BUILDING', 'MACHINERY') THEN 'min10' ELSE 'max9' END AS field_rule
  FROM ({RESULTS}) r JOIN orders ON o_orderkey = ord"""


def routed(staged: str) -> str:
    """SQL of rows with their round and the number of the table that their placing points come from."""
    return f"""SELECT *, CASE WHEN round_kind = 'final' AND grp = 'BUILDING' AND discipline = '1-URGENT' THEN 'MACHINERY' WHEN round_kind = 'final' THEN grp
  WHEN round_kind = 'before_final' AND grp IN ('HOUSEHOLD', 'BUILDING') AND category = '1' THEN 'HOUSEHOLD' WHEN round_kind = 'before_final' AND field_rule = 'min10' THEN 'AUTOMOBILE' WHEN round_kind = 'before_final' THEN 'FURNITURE' END AS table_no FROM ({staged})"""


_ROUTED = routed(_STAGED)


def _placing_with_q(spark, sf):
    p = placing(spark, sf)
    return p.unionByName(p.groupBy("table_no", "category").agg((F.max("points") + 1).alias("points")).withColumn("place_key", F.lit("Q")))


def _routes(spark, sf):
    """Each segment's own table for finals and two tables by field size before them; one discipline and one category have their own."""
    grp = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("grp")).distinct()
    row = lambda kind, by, selector, table: F.struct(F.lit(kind).alias("round_kind"), F.lit(by).alias("selector_kind"), F.lit(selector).cast("string").alias("selector"), (table if table is not None else F.col("grp")).alias("table_no"))
    rows = F.array(
        row("final", "group", None, None), row("before_final", "size", "min10", F.lit("AUTOMOBILE")), row("before_final", "size", "max9", F.lit("FURNITURE")),
        F.when(F.col("grp") == "BUILDING", row("final", "discipline", "1-URGENT", F.lit("MACHINERY"))), F.when(F.col("grp").isin("HOUSEHOLD", "BUILDING"), row("before_final", "category", "1", F.lit("HOUSEHOLD"))),
    )
    return grp.select("grp", F.explode(rows).alias("r")).where("r is not null").select("grp", "r.*")


@query(f"""SELECT s.ord, s.round_kind, coalesce(p.points, 0)::INT AS placing_points FROM ({_ROUTED}) s LEFT JOIN ({TABLES}) p ON p.table_no = s.table_no AND p.category = s.category
  AND p.place_key = CASE WHEN round_kind = 'before_final' AND advanced THEN 'Q' ELSE s.place::VARCHAR END""")
def j2_all_routes(spark, sf):
    """Finals by group and by discipline, the round before by category and by field size, the row that advanced, other rounds."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("discipline"))
    r = results(spark, sf).join(o, "ord")
    nth = F.col("ord") % 3
    r = r.withColumn("round_kind", F.element_at(F.array(*map(F.lit, ("final", "before_final", "other"))), (nth + 1).cast("int"))).withColumn("advanced", (nth == 1) & (F.col("ord") % 5 == 0))
    r = r.withColumn("field_rule", F.when(F.col("grp").isin("BUILDING", "MACHINERY"), "min10").otherwise("max9"))
    return scoring.placing_points(r, _routes(spark, sf), _placing_with_q(spark, sf)).select("ord", "round_kind", "placing_points")


@query(f"""SELECT r.ord, l.points AS mark_points, coalesce(t.points, 0)::INT AS placing_points, (l.points + coalesce(t.points, 0))::BIGINT AS score
FROM ({RESULTS}) r JOIN ({REACHED}) l ON l.probe_id = r.ord LEFT JOIN ({TABLES}) t ON t.table_no = r.grp AND t.category = r.category AND t.place_key = r.place::VARCHAR""")
def c1_scenario_scores(spark, sf):
    """What a mark and a place in a final would earn: ladder points, of heights and of times, and the group's own placing table, whatever the discipline."""
    p = probes(spark, sf).select(F.col("probe_id").alias("ord"), "slug", F.col("probe").alias("mark_c"))
    s = results(spark, sf).select("ord", "grp", "category", "place").join(p, "ord")
    return scoring.scenario_scores(s, ladder(spark, sf), _routes(spark, sf), _placing_with_q(spark, sf), higher="higher").select("ord", "mark_points", "placing_points", "score")


@query(f"SELECT ord, {INSIDE_SQL} AS inside FROM ({RESULTS})")
def p9_window_predicate(spark, sf):
    return results(spark, sf).select("ord", _inside().alias("inside"))


@query(f"SELECT athlete, grp, ord, total_score, counting_rank FROM ({COUNTING})")
def w4_counting_top5(spark, sf):
    return _counting(spark, sf).select("athlete", "grp", "ord", "total_score", F.col("counting_rank").cast("bigint").alias("counting_rank"))


@query(f"""SELECT athlete, grp, bool_and(d BETWEEN DATE '2000-07-31' AND DATE '{RANK_DATE}') AS sound FROM ({COUNTING}) GROUP BY athlete, grp""")
def a3_window_soundness(spark, sf):
    inside = F.col("d").between(F.lit("2000-07-31").cast("date"), F.lit(RANK_DATE).cast("date"))
    return C.window_soundness(_counting(spark, sf), ["athlete", "grp"], inside)


@query(f"""SELECT *, (CASE WHEN n_counting < 5 THEN (sum_score + added) // (n_counting + 1) WHEN added > cap THEN (sum_score - cap + added) // n_counting ELSE sum_score // n_counting END)::BIGINT AS new_score,
  (n_counting < 5 OR added > cap) AS counts, CASE WHEN n_counting = 5 AND added > cap THEN cap END AS dropped
  FROM (SELECT athlete, grp, n_counting, sum_score, cap, (cap + 40)::BIGINT AS added FROM ({RANKED}))""")
def c3_one_more_result(spark, sf):
    base = _ranked(spark, sf).select("athlete", "grp", "n_counting", "sum_score", "cap").withColumn("added", F.col("cap") + 40)
    return C.with_one_more(base, "added")


@query("""WITH e AS (SELECT event_id, user_id, ts::DATE AS day, CASE event_type WHEN 'purchase' THEN 9 WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS s FROM events)
SELECT event_id, CASE WHEN s = 9 THEN 'final' WHEN s > 0 AND s = max(CASE WHEN s < 9 THEN s END) OVER w THEN 'before_final' ELSE 'other' END AS round_kind,
  (max(s) OVER w = 9 AND s < 9) AS advanced FROM e WINDOW w AS (PARTITION BY user_id, day)""")
def w1_w2_rounds(spark, sf):
    return rounds.classify_rounds(stages(spark, sf), ["user_id", "day"]).select("event_id", "round_kind", "advanced")


@query(f"SELECT probe_id, points FROM ({REACHED})")
def j3_asof_ladder(spark, sf):
    return scoring.asof_points(probes(spark, sf), ladder(spark, sf), ["slug"], F.col("probe"), higher="higher").select("probe_id", "points")


@query(f"SELECT probe_id, points FROM ({REACHED})")
def j3_asof_by_union(spark, sf):
    return scoring.asof_points_by_union(probes(spark, sf), ladder(spark, sf), ["slug"], F.col("probe"), higher="higher").select("probe_id", "points")


_EVEN = f"SELECT mark_c, points * 3 AS points FROM ({LADDER}) WHERE slug = 'even'"


@query(f"""WITH l AS ({_EVEN}), s AS (SELECT o_orderkey AS id, (floor(o_totalprice) % 1700)::BIGINT AS score FROM orders),
  x AS (SELECT DISTINCT score FROM s), n AS (SELECT score, arg_min(mark_c, abs(points - score) * 1000000 - mark_c) AS mark_c FROM x, l GROUP BY score)
SELECT id, score, mark_c FROM s JOIN n USING (score)""")
def j4_nearest_mark(spark, sf):
    s = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 1700).cast("bigint").alias("score"))
    even = ladder(spark, sf).where("slug = 'even'").withColumn("points", F.col("points") * 3)
    return scoring.nearest_mark(s, even, "score")


@query(f"""SELECT p.probe_id, l.points::BIGINT AS points, l.points IS NOT NULL AS listed FROM ({PROBES}) p LEFT JOIN ({LADDER}) l ON p.slug = l.slug AND p.probe_c = l.mark_c""")
def j5_exact_lookup(spark, sf):
    hit, miss = scoring.exact_points(probes(spark, sf).withColumnRenamed("probe_c", "mark_c"), ladder(spark, sf), ["slug", "mark_c"])
    return hit.select("probe_id", "points", F.lit(True).alias("listed")).unionByName(miss.select("probe_id", F.lit(None).cast("bigint").alias("points"), F.lit(False).alias("listed")))


_AUTO = f"SELECT category, place_key, points FROM ({PLACING}) WHERE table_no = 'AUTOMOBILE'"


@query(f"""SELECT r.ord, c.category, (r.mark_points + coalesce(p.points, 0))::INT AS total_score FROM ({RESULTS}) r CROSS JOIN (SELECT DISTINCT category FROM ({_AUTO})) c
  LEFT JOIN ({_AUTO}) p ON p.category = c.category AND p.place_key = r.place::VARCHAR""")
def a6_category_comparison(spark, sf):
    auto = placing(spark, sf).where("table_no = 'AUTOMOBILE'")
    return scoring.category_comparison(results(spark, sf).drop("category"), auto, auto).select("ord", "category", "total_score")


@query(f"""SELECT * FROM (PIVOT (SELECT r.mark_points, 'c' || c.category AS category, (r.mark_points + coalesce(p.points, 0))::INT AS total_score
  FROM ({RESULTS}) r CROSS JOIN (SELECT DISTINCT category FROM ({_AUTO})) c LEFT JOIN ({_AUTO}) p ON p.category = c.category AND p.place_key = r.place::VARCHAR) ON category USING max(total_score) GROUP BY mark_points)""")
def a7_score_series(spark, sf):
    """A column for each category of the placing table."""
    auto = placing(spark, sf).where("table_no = 'AUTOMOBILE'")
    return scoring.score_series(scoring.category_comparison(results(spark, sf).drop("category"), auto, auto), prefix="c")


def _line_order():
    return [F.col("score").desc(), F.col("mark_points").desc(), F.col("d").desc(), F.col("comp"), F.col("race"), F.col("part")]


_IN_YEAR = "d BETWEEN DATE '2000-07-31' AND DATE '2001-07-31'"
_BEST = f"SELECT * FROM ({LINES}) QUALIFY row_number() OVER (PARTITION BY athlete, comp, race ORDER BY score DESC, mark_points, d, part) = 1"
_LINE_ORDER = "score DESC, mark_points DESC, d DESC, comp, race, part"
_LC = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY {_LINE_ORDER}) AS counting_rank FROM ({_BEST}) WHERE {_IN_YEAR}) WHERE counting_rank <= 5"
_SUBS = f"""SELECT b.*, row_number() OVER (PARTITION BY b.athlete ORDER BY {_LINE_ORDER}) AS substitute_rank FROM ({_BEST}) b JOIN (SELECT athlete, min(score) AS cap FROM ({_LC}) GROUP BY athlete) c USING (athlete)
  WHERE {_IN_YEAR} AND score <= cap AND NOT EXISTS (SELECT 1 FROM ({_LC}) k WHERE k.athlete = b.athlete AND k.comp = b.comp AND k.race = b.race)"""


def _lines(spark, sf):
    """(best of each round inside the window, counting, caps, substitutes). The first is written once, as all others read it."""
    best = C.best_per_round(lines(spark, sf), ["athlete", "comp", "race"], "score", ["mark_points", "d", "part"])
    year = best.where(F.col("d").between(F.lit("2000-07-31").cast("date"), F.lit("2001-07-31").cast("date")))
    path = shared_folder(spark, "rounds")
    year.write.parquet(path)
    year = spark.read.schema(year.schema).parquet(path)
    counting = C.top_n(year, ["athlete"], _line_order())
    caps = C.ranking_score(counting, ["athlete"], "score")
    return year, counting, caps, C.substitutes(year, counting, caps, ["athlete"], ["comp", "race"], _line_order(), "score")


@query(f"SELECT athlete, comp, race, score, part FROM ({_BEST})")
def w3_best_per_round(spark, sf):
    return C.best_per_round(lines(spark, sf), ["athlete", "comp", "race"], "score", ["mark_points", "d", "part"]).select("athlete", "comp", "race", "score", "part")


@query(f"SELECT athlete, comp, race, score, substitute_rank FROM ({_SUBS})")
def w5_substitutes(spark, sf):
    """What could take the place of a counting result, up to the cap."""
    return _lines(spark, sf)[3].select("athlete", "comp", "race", "score", F.col("substitute_rank").cast("bigint").alias("substitute_rank"))


@query(f"""WITH c AS ({_LC}), f AS (SELECT athlete, count(*) AS freed FROM c WHERE counting_rank IN (1, 3) GROUP BY athlete),
  k AS (SELECT athlete, score FROM c WHERE counting_rank NOT IN (1, 3) UNION ALL SELECT s.athlete, s.score FROM ({_SUBS}) s JOIN f USING (athlete) WHERE substitute_rank <= freed)
SELECT athlete, floor(avg(score))::BIGINT AS ranking_score, count(*) AS n_counting FROM k GROUP BY athlete""")
def w6_recount(spark, sf):
    _, counting, _, subs = _lines(spark, sf)
    out = C.recount(counting, subs, counting.where("counting_rank in (1, 3)"), ["athlete"], ["comp", "race"], "score")
    return out.select("athlete", "ranking_score", "n_counting")


@query(f"""WITH p AS (SELECT *, count(*) OVER w AS len, row_number() OVER (PARTITION BY athlete ORDER BY {_LINE_ORDER}) - 1 AS pos FROM ({_BEST}) WINDOW w AS (PARTITION BY athlete))
SELECT athlete, comp, race FROM p WHERE len <= 7 OR pos IN (SELECT (i * len) // 7 FROM range(7) r(i))""")
def w16_spread_sample(spark, sf):
    best = C.best_per_round(lines(spark, sf), ["athlete", "comp", "race"], "score", ["mark_points", "d", "part"])
    return C.spread_sample(best, ["athlete"], _line_order(), 7).select("athlete", "comp", "race")


@query(f"""SELECT athlete, arg_max(part::VARCHAR, (mark_points, -comp, -race, -part)) AS best FROM ({LINES}) GROUP BY athlete""")
def a5_season_best(spark, sf):
    from ..operators.changes import season_best

    rows = lines(spark, sf).withColumn("text", F.col("part").cast("string")).withColumn("o", F.struct((-F.col("comp")).alias("a"), (-F.col("race")).alias("b"), (-F.col("part")).alias("c")))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("athlete").orderBy("comp", "race", "part")))
    return season_best(rows, ["athlete"], "text", "mark_points", True, "ord")


@query("""SELECT c_mktsegment AS grp, o_orderpriority AS discipline, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR (c_mktsegment = 'FURNITURE' AND o_orderpriority = '5-LOW') GROUP BY ALL""")
def j1_discipline_membership(spark, sf):
    groups = spark.createDataFrame([("BUILDING", ["1-URGENT", "2-HIGH"]), ("MACHINERY", ["1-URGENT", "2-HIGH", "2-HIGH"]), ("FURNITURE", ["5-LOW"])], "gender string, disciplines array<string>")
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("gender"), F.col("o_orderpriority").alias("discipline"))
    return C.in_disciplines(rows, groups).groupBy(F.col("gender").alias("grp"), "discipline").agg(F.count("*").alias("n"))
