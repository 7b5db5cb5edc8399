"""Pools with country quotas, and what-if places in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quota as Q
from ..operators import scenarios as S
from .bindings import POOL, pool
from .registry import query

_PRE = f"SELECT event, country, count(*) AS pre FROM ({POOL}) WHERE type = 'q1' GROUP BY event, country"
_OPEN = f"SELECT * FROM ({POOL}) WHERE type = 'q4'"
_WALK = f"""SELECT o.*, coalesce(pre, 0) AS pre, row_number() OVER (PARTITION BY o.event, o.country ORDER BY score DESC, athlete) AS country_rank FROM ({_OPEN}) o
  LEFT JOIN ({_PRE}) p ON o.event = p.event AND o.country = p.country"""
CAP = 90  # wide enough that most countries keep free places behind their fixed entries
_RANKED = f"""SELECT *, CASE WHEN country_rank <= {CAP} - pre THEN sum((country_rank <= {CAP} - pre)::INT) OVER (PARTITION BY event ORDER BY score DESC, athlete ROWS UNBOUNDED PRECEDING)::BIGINT END AS pool_rank FROM ({_WALK})"""


def _order():
    return [F.col("score").desc(), F.col("athlete").asc()]


def _pre(spark, sf):
    return Q.pre_occupied(pool(spark, sf), ["event"])


def _open(spark, sf):
    return pool(spark, sf).where("type = 'q4'")


def _ranked(spark, sf):
    return Q.quota_rank(_open(spark, sf), _pre(spark, sf), ["event"], _order(), cap=CAP)


@query(_PRE)
def a4_pre_occupancy(spark, sf):
    return _pre(spark, sf)


@query(f"SELECT event, athlete, country_rank, pool_rank FROM ({_RANKED})")
def w7_quota_rank(spark, sf):
    return _ranked(spark, sf).select("event", "athlete", "country_rank", "pool_rank")


@query(f"SELECT event, athlete, pool_rank FROM ({_RANKED}) WHERE pool_rank IS NOT NULL")
def w7_quota_rank_huge(spark, sf):
    """The same ranks without a window over a whole pool."""
    return Q.quota_rank_huge(_open(spark, sf).withColumn("pos", -F.col("score")), _pre(spark, sf), ["event"], "pos", cap=CAP, then=[F.col("athlete")]).select("event", "athlete", F.col("pool_rank").cast("bigint").alias("pool_rank"))


@query(f"""SELECT event, athlete, row_number() OVER (PARTITION BY event ORDER BY score DESC, athlete) + 48 - 30 AS uncapped_position,
  pool_rank + 18 AS qualifying_position, coalesce(pool_rank <= 30, false) AS inside_quota FROM ({_RANKED})""")
def w8_w9_positions(spark, sf):
    out = Q.uncapped_position(_ranked(spark, sf), ["event"], "score", [F.col("athlete")], F.lit(48), F.lit(30))
    return Q.qualifying(out, F.lit(30), F.lit(18)).select("event", "athlete", F.col("uncapped_position").cast("bigint").alias("uncapped_position"), "qualifying_position", "inside_quota")


@query(f"""SELECT event, athlete, rank() OVER (PARTITION BY event, country ORDER BY score DESC) + pre AS country_place, rank() OVER (PARTITION BY event ORDER BY score DESC) AS projected_place FROM ({_WALK})""")
def w10_w11_places(spark, sf):
    rows = _open(spark, sf).join(_pre(spark, sf), ["event", "country"], "left")
    return Q.projected_place(Q.rank_in_country(rows, ["event"], "score"), ["event"], "score").select("event", "athlete", "country_place", "projected_place")


@query(f"""SELECT athlete, CASE WHEN score > 9000 THEN athlete ELSE coalesce(pool_rank + 18, u) END AS standing, CASE WHEN score > 9000 THEN 'official' WHEN pool_rank IS NOT NULL THEN 'capped' ELSE 'country' END AS standing_kind
  FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY score DESC, athlete) + 18 AS u FROM ({_RANKED}))""")
def w12_displayed_standing(spark, sf):
    rows = Q.qualifying(Q.uncapped_position(_ranked(spark, sf), ["event"], "score", [F.col("athlete")], F.lit(48), F.lit(30)), F.lit(30), F.lit(18))
    rows = rows.withColumn("qualified", F.col("score") > 9000).withColumn("official_position", F.col("athlete"))
    return Q.displayed_standing(rows).select("athlete", "standing", "standing_kind")


_ASK = "SELECT n_regionkey AS event, n_name AS country, s_suppkey AS id, floor(s_acctbal)::BIGINT AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _asked(spark, sf):
    from .bindings import t

    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("event"), F.col("n_name").alias("country"), F.col("s_suppkey").alias("id"), F.floor("s_acctbal").cast("bigint").alias("ask"))


@query(f"SELECT id, (SELECT count(*) FROM ({_OPEN}) p WHERE p.event = a.event AND p.score > a.score) + 1 AS place FROM ({_ASK}) a")
def c2_place_among_peers(spark, sf):
    return S.place_among(_asked(spark, sf), _open(spark, sf), ["event"], "ask").select("id", "place")


@query(f"""WITH a AS ({_ASK}), pre AS ({_PRE}), o AS ({_OPEN}),
  own AS (SELECT a.id, count(o.athlete) AS better FROM a LEFT JOIN o ON o.event = a.event AND o.country = a.country AND o.score > a.score GROUP BY a.id),
  per AS (SELECT a.id, o.country, count(*) AS better FROM a JOIN o ON o.event = a.event AND o.score > a.score GROUP BY a.id, o.country),
  ahead AS (SELECT per.id, sum(least(per.better, greatest(0, {CAP} - coalesce(pre.pre, 0)))) AS n, sum(per.better) AS m FROM per JOIN a USING (id) LEFT JOIN pre ON pre.event = a.event AND pre.country = per.country GROUP BY per.id)
SELECT a.id, CASE WHEN own.better < greatest(0, {CAP} - coalesce(pre.pre, 0)) THEN coalesce(ahead.n, 0) + 1 END::BIGINT AS quota_place, (coalesce(ahead.m, 0) + 1)::BIGINT AS uncapped_place, own.better + 1 + coalesce(pre.pre, 0) AS country_place
FROM a JOIN own USING (id) LEFT JOIN ahead USING (id) LEFT JOIN pre ON pre.event = a.event AND pre.country = a.country""")
def c4_quota_place(spark, sf):
    out = S.quota_place(_asked(spark, sf), _open(spark, sf), _pre(spark, sf), ["event"], "ask", cap=CAP)
    return out.select("id", "quota_place", "uncapped_place", "country_place")
