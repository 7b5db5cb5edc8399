"""Snapshots of users by day: differences, composition, digests, outbox."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import changes as D
from .bindings import SNAPSHOTS, snapshots, t
from .registry import query

def _before(snaps, days=1):
    """Snapshots under the day that they are compared with."""
    return snaps.withColumn("period", F.date_add("period", days))


def _steps(spark, sf):
    """(the day before's snapshots, those of each day), over all days."""
    s = snapshots(spark, sf)
    return _before(s), s


KEY = ["user_id", "period"]
_STEP = f"FROM ({SNAPSHOTS}) a JOIN ({SNAPSHOTS}) b ON a.user_id = b.user_id AND a.period + 1 = b.period"


@query(f"""SELECT b.user_id, b.period, 'place' AS scope, a.place AS from_value, b.place AS to_value, CASE WHEN b.place < a.place THEN 'up' ELSE 'down' END AS direction {_STEP} WHERE a.place <> b.place
UNION ALL SELECT b.user_id, b.period, 'n', a.n, b.n, CASE WHEN b.n < a.n THEN 'up' ELSE 'down' END {_STEP} WHERE a.n <> b.n""")
def d1_place_changes(spark, sf):
    return D.place_changes(*_steps(spark, sf), KEY, ["place", "n"])


@query(f"""SELECT b.user_id, b.period, a.score::DECIMAL(18,4) AS from_value, b.score::DECIMAL(18,4) AS to_value, (b.score - a.score)::DECIMAL(20,2) AS delta {_STEP} WHERE a.score <> b.score""")
def d2_score_changes(spark, sf):
    return D.score_changes(*_steps(spark, sf), KEY, "score")


@query(f"SELECT b.user_id, b.period, a.qualified AS from_value, b.qualified AS to_value {_STEP} WHERE a.qualified <> b.qualified")
def d3_qualification_flips(spark, sf):
    return D.flips(*_steps(spark, sf), KEY, "qualified")


@query(f"SELECT user_id, period, place FROM ({SNAPSHOTS}) QUALIFY lag(period) OVER (PARTITION BY user_id ORDER BY period) IS NOT NULL")
def d4_period_gate(spark, sf):
    s = snapshots(spark, sf).withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("period")))
    return D.gated(s.withColumn("nth", F.col("nth") + 1), s, ["user_id", "nth"], "period").select("user_id", "period", "place")


_MOVED = f"SELECT b.user_id, b.period, a.place AS f, b.place AS t, CASE WHEN b.qualified THEN b.n END AS intro {_STEP} WHERE a.place <> b.place"


@query(f"""SELECT user_id, coalesce(x.period + 1, y.period) AS period, coalesce(x.f, y.f) AS from_value, coalesce(y.t, x.t) AS to_value, coalesce(x.intro, y.intro) AS intro FROM ({_MOVED}) x FULL JOIN ({_MOVED}) y ON x.user_id = y.user_id AND x.period + 1 = y.period
WHERE coalesce(x.f, y.f) IS DISTINCT FROM coalesce(y.t, x.t)""".replace("SELECT user_id, coalesce(x.period", "SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.period"))
def d5_composed(spark, sf):
    """Each day's change composed with the next day's; an introduction that is owed stays owed."""
    prev, cur = _steps(spark, sf)
    intro = cur.select(*KEY, F.when(F.col("qualified"), F.col("n")).alias("intro"))
    step = D.place_changes(prev, cur, KEY, ["place"]).join(intro, KEY)
    return D.composed(_before(step), step, KEY, ["intro"])


def _chain(spark, sf):
    w = Window.partitionBy("user_id").orderBy("period")
    s = snapshots(spark, sf).withColumn("from_value", F.lag("place").over(w)).withColumnRenamed("place", "to_value")
    return s.where("from_value is not null and from_value <> to_value").select("user_id", "period", "from_value", "to_value")


@query(f"""SELECT user_id, arg_min(f, period) AS from_value, arg_max(place, period) AS to_value, count(*) AS n_steps FROM
  (SELECT *, lag(place) OVER (PARTITION BY user_id ORDER BY period) AS f FROM ({SNAPSHOTS})) WHERE f <> place GROUP BY user_id HAVING arg_min(f, period) <> arg_max(place, period)""")
def d5_composed_chain(spark, sf):
    return D.composed_chain(_chain(spark, sf), ["user_id"], "period")


@query(f"SELECT user_id, period, place - lag(place) OVER w AS place_delta, score - lag(score) OVER w AS score_delta FROM ({SNAPSHOTS}) WINDOW w AS (PARTITION BY user_id ORDER BY period)")
def w13_period_delta(spark, sf):
    return D.period_delta(snapshots(spark, sf), ["user_id"], "period", ["place", "score"])


@query(f"SELECT user_id, period, CASE WHEN l IS NULL THEN NULL ELSE sign(l - place)::INT END AS direction, abs(place - l) AS size FROM (SELECT *, lag(place) OVER (PARTITION BY user_id ORDER BY period) AS l FROM ({SNAPSHOTS}))")
def p11_change_label(spark, sf):
    s = snapshots(spark, sf).withColumn("l", F.lag("place").over(Window.partitionBy("user_id").orderBy("period")))
    return s.select("user_id", "period", X.change_label(F.col("l"), F.col("place"), up_is_good=False).alias("x")).select("user_id", "period", "x.direction", "x.size")


_HALF = "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'"
_REST = "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15'"


@query(f"SELECT event_id FROM ({_REST}) e WHERE NOT EXISTS (SELECT 1 FROM ({_HALF}) h WHERE h.user_id = e.user_id AND h.event_type = e.event_type AND floor(h.value) = floor(e.value))")
def u1_new_rows(spark, sf):
    e = t(spark, sf, "events").withColumn("v", F.floor("value"))
    return D.new_rows(e.where("ts >= '2024-01-15'"), e.where("ts < '2024-01-15'"), ["user_id", "event_type", "v"]).select("event_id")


@query(f"SELECT event_id FROM (SELECT *, 0 AS side FROM ({_REST}) UNION ALL SELECT *, 1 FROM ({_HALF})) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY side, event_id) = 1")
def u2_first_wins(spark, sf):
    e = t(spark, sf, "events")
    return D.first_wins(e.where("ts >= '2024-01-15'"), e.where("ts < '2024-01-15'"), ["user_id", "event_type"], "event_id").select("event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def u4_last_name(spark, sf):
    return D.last_name(t(spark, sf, "events").withColumnRenamed("event_type", "last_type"), ["user_id"], "last_type", "event_id")


@query("""WITH d AS (SELECT user_id, event_id % 300 AS athlete, (event_id % 300) % 7 <> 0 AS resolved, CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'error' END AS status, 'g' || (event_id % 300) % 4 AS grp, ts::DATE::VARCHAR AS period FROM events)
SELECT count(DISTINCT user_id) AS users, count(DISTINCT athlete) AS athletes, count(DISTINCT athlete) FILTER (resolved) AS resolved, count(DISTINCT athlete) FILTER (NOT resolved) AS skipped, count(*) FILTER (status = 'sent') AS sent,
  count(*) FILTER (status = 'error') AS failed, (SELECT string_agg(grp || '=' || p, ',' ORDER BY grp) FROM (SELECT grp, max(period) AS p FROM d WHERE resolved GROUP BY grp)) AS rank_dates FROM d""")
def a9_run_report(spark, sf):
    athlete = F.col("event_id") % 300
    status = F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "error", "error")
    d = t(spark, sf, "events").select("user_id", athlete.alias("athlete"), (athlete % 7 != 0).alias("resolved"), status.alias("status"), F.concat(F.lit("g"), athlete % 4).alias("grp"), F.col("ts").cast("date").cast("string").alias("period"))
    dates = F.transform(F.map_entries("rank_dates"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return D.run_report(d).withColumn("rank_dates", F.array_join(dates, ","))


@query(f"""SELECT user_id, count(DISTINCT scope) AS n_athletes, count(*) AS n_items, string_agg(line, chr(10) ORDER BY period, scope) AS body FROM
  (SELECT user_id, period, 'p' || (place % 7) AS scope, period::VARCHAR || ' place ' || place AS line FROM ({SNAPSHOTS}) WHERE place <= 10) GROUP BY user_id""")
def a10_digest(spark, sf):
    items = snapshots(spark, sf).where("place <= 10").select("user_id", "period", F.concat(F.lit("p"), F.col("place") % 7).alias("scope"), F.concat(F.col("period").cast("string"), F.lit(" place "), F.col("place")).alias("line"))
    return D.digest(items, "user_id", "scope", "line", ["period", "scope"])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 50 AS kept FROM events")
def a11_limit_per_key(spark, sf):
    kept, over = D.within_limit(t(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 50)
    return kept.select("event_id", F.lit(True).alias("kept")).unionByName(over.select("event_id", F.lit(False).alias("kept")))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC) AS newest FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def t3_newest_first(spark, sf):
    out = D.newest_first(t(spark, sf, "events").where("event_type = 'purchase'"), ["user_id"], ["ts"], "event_id")
    return out.select("user_id", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("newest"))


@query(f"""SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.period, a.period + 1) AS period, CASE WHEN b.user_id IS NULL THEN a.place ELSE coalesce(nullif(b.place, 1), a.place) END AS place, CASE WHEN b.user_id IS NULL THEN a.score ELSE b.score END AS score
  FROM ({SNAPSHOTS}) a FULL JOIN ({SNAPSHOTS}) b ON a.user_id = b.user_id AND a.period + 1 = b.period""")
def s10_snapshot_upsert(spark, sf):
    """Each day's snapshots over those of the day before; a place that could not be read (here the first) keeps the stored one."""
    old, new = _steps(spark, sf)
    cols = ["user_id", "period", "place", "score"]
    return D.upserted(old.select(*cols), new.withColumn("place", F.nullif(F.col("place"), F.lit(1))).select(*cols), KEY, ["place"])


@query("""WITH c AS (SELECT DISTINCT user_id, ts::DATE AS period FROM events WHERE event_type = 'click'), s AS (SELECT DISTINCT user_id, ts::DATE AS period FROM events WHERE event_type = 'purchase')
SELECT user_id, period FROM c ANTI JOIN s USING (user_id, period)""")
def r3_unsent(spark, sf):
    e = t(spark, sf, "events").withColumn("period", F.col("ts").cast("date"))
    log = e.where("event_type in ('purchase', 'error')").withColumn("status", F.when(F.col("event_type") == "purchase", "sent").otherwise("error"))
    return D.unsent(e.where("event_type = 'click'").select("user_id", "period").distinct(), log, ["user_id", "period"])


@query("""SELECT user_id, kind, event_id FROM (SELECT user_id, event_type AS kind, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1) WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def r4_live_outbox(spark, sf):
    box = t(spark, sf, "events").select("user_id", F.col("event_type").alias("kind"), "event_id", F.col("ts").cast("timestamp").alias("updated_at"))
    return D.live_outbox(box, F.lit("2024-01-31").cast("timestamp")).select("user_id", "kind", "event_id")


@query("""WITH saved AS (SELECT user_id, event_type AS kind, max(event_id) AS id FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL), old AS (SELECT user_id, event_type AS kind, max(event_id) AS id FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL)
SELECT * FROM (SELECT * FROM saved UNION ALL SELECT * FROM old ANTI JOIN saved USING (user_id, kind)) WHERE kind <> 'error'""")
def s11_outbox(spark, sf):
    from ..sources.writers import outbox_after

    e = t(spark, sf, "events").select("user_id", F.col("event_type").alias("kind"), "event_id", "ts")
    side = lambda cond: e.where(cond).groupBy("user_id", "kind").agg(F.max("event_id").alias("id"))
    return outbox_after(side("ts < '2024-01-15'"), side("ts >= '2024-01-15'"), e.where("kind = 'error'").select("user_id", "kind").distinct(), ["user_id", "kind"])


@query(f"""WITH f AS (SELECT c_custkey AS fan, c_custkey % 150 AS user_id FROM customer), st AS (SELECT user_id, arg_max(place, period) AS place FROM ({SNAPSHOTS}) GROUP BY user_id), sn AS (SELECT user_id, sum(score)::BIGINT AS score FROM ({SNAPSHOTS}) GROUP BY user_id)
SELECT fan, user_id, place, score FROM f LEFT JOIN st USING (user_id) LEFT JOIN sn USING (user_id)""")
def j11_fan_out(spark, sf):
    """The last place and the whole score of the athletes that anyone follows, to all followers."""
    from ..operators.lookup import fanned_out

    f = t(spark, sf, "customer").select(F.col("c_custkey").alias("fan"), (F.col("c_custkey") % 150).alias("user_id"))
    s = snapshots(spark, sf)
    last, whole = s.groupBy("user_id").agg(F.max_by("place", "period").alias("place")), s.groupBy("user_id").agg(F.sum("score").alias("score"))
    return fanned_out(f, last, whole, "user_id").select("fan", "user_id", "place", "score")


@query(f"""WITH f AS (SELECT c_custkey AS fan, c_custkey % 150 AS user_id, c_acctbal > 5000 AS intro_sent FROM customer)
SELECT fan, b.user_id, b.period, b.place {_STEP} JOIN f ON f.user_id = b.user_id WHERE NOT intro_sent AND a.place <> b.place""")
def d6_introductions(spark, sf):
    f = t(spark, sf, "customer").select(F.col("c_custkey").alias("fan"), (F.col("c_custkey") % 150).alias("user_id"), (F.col("c_acctbal") > 5000).alias("intro_sent"))
    prev, cur = _steps(spark, sf)
    s = cur.join(prev.select(*KEY, F.col("place").alias("was")), KEY).withColumn("rank_advanced", F.col("place") != F.col("was"))
    return D.introductions(f, s, "user_id").select("fan", "user_id", "period", "place")
