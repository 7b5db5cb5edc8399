"""Streams over the given tables: rows land slice by slice, each is drained with availableNow, and the whole equals its batch twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import cadences, jobs, standings
from .bindings import SNAPSHOTS, shared_folder, snapshots, t
from .change_queries import _chain
from .registry import query


def _folder(spark) -> str:
    return shared_folder(spark, "stream")


def _once(spark, df):
    """df, computed once: slices, runs and followers read what is written."""
    path = f"{_folder(spark)}/once"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _landing(df, day: str, slices: int, path: str, kind: str = "parquet"):
    """Lands df under `path` in order of its days, a slice at a time, and stops after each; text has the column `value` alone."""
    days = [r[0] for r in df.select(F.col(day)).distinct().orderBy(day).collect()]  # one value per day
    for i in range(slices):
        some = days[i * len(days) // slices : (i + 1) * len(days) // slices]
        if some:
            rows = df.where(F.col(day).between(F.lit(some[0]), F.lit(some[-1])))
            (rows.select("value") if kind == "text" else rows).write.mode("append").format(kind).save(path)
            yield i


def _arriving(spark, df, day: str, slices: int, path: str):
    """The stream of all that came so far, after each slice of days."""
    for _ in _landing(df, day, slices, path):
        yield spark.readStream.schema(df.schema).parquet(path)


@query("""SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL)
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def r7_daily_rollup(spark, sf):
    """Tumbling days in append mode: those that the watermark, two days behind the newest event, has passed."""
    folder = _folder(spark)
    e = t(spark, sf, "events").select("ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.col("ts").cast("date").alias("day"))
    for stream in _arriving(spark, e, "day", 3, f"{folder}/events"):
        out = jobs.drained(jobs.rolled_up(stream, "ts", "1 day", "2 days", ["event_type"], "cents"), folder)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def _with_state(spark, run):
    """Runs a stream with the state store that keyed state needs, and puts the session's own back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, standings.STATE_STORE)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


# Standings of users by day; some fields are unknown on some days, and each user's results cannot be read every fifth day.
_STANDINGS = f"""SELECT user_id::VARCHAR AS key, period::VARCHAR AS period, place AS world, CASE WHEN user_id % 3 > 0 THEN (place + 1) // 2 END AS european, score, CASE WHEN n % 4 > 0 THEN qualified END AS qualified,
  CASE WHEN (user_id + day(period)) % 5 > 0 THEN items END AS results, row_number() OVER (PARTITION BY user_id ORDER BY period) AS nth
  FROM ({SNAPSHOTS}) JOIN (SELECT user_id, ts::DATE AS period, list(DISTINCT event_type) AS items FROM events GROUP BY ALL) USING (user_id, period)"""


def _standings(spark, sf):
    items = t(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("period")).agg(F.collect_set("event_type").alias("items"))
    s = snapshots(spark, sf).join(items, ["user_id", "period"])
    s = s.select(
        F.col("user_id").cast("string").alias("key"), F.col("period").cast("string").alias("period"), F.col("place").cast("bigint").alias("world"), F.when(F.col("user_id") % 3 > 0, F.floor((F.col("place") + 1) / 2)).cast("bigint").alias("european"),
        "score", F.when(F.col("n") % 4 > 0, F.col("qualified")).alias("qualified"), F.when((F.col("user_id") + F.dayofmonth("period")) % 5 > 0, F.col("items")).alias("results"),
    )
    return _once(spark, s)


_KINDS = "\n".join(f"UNION ALL SELECT key, period, '{c}', f_{c}::BIGINT, {c}::BIGINT, NULL FROM l WHERE f_{c} <> {c}" for c in standings.COMPARED)


@query(f"""WITH l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS f_{c}" for c in standings.COMPARED)}, last_value(results IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had
  FROM ({_STANDINGS}) WINDOW w AS (PARTITION BY key ORDER BY period))
SELECT key, period, 'result' AS kind, NULL::BIGINT AS from_value, NULL::BIGINT AS to_value, item FROM (SELECT key, period, unnest(list_filter(results, lambda x: NOT list_contains(coalesce(had, []), x))) AS item FROM l WHERE nth > 1)
{_KINDS}""")
def r1_snapshot_changes(spark, sf):
    """R1, R2 with D1, D2, D3, U1 in the stream: places, scores and qualification on a new period, new results on any. Snapshots come in three slices of days."""
    folder = _folder(spark)

    def run():
        for stream in _arriving(spark, _standings(spark, sf), "period", 3, f"{folder}/snapshots"):
            out = jobs.drained(standings.standing_changes(stream), folder)
        return out

    return _with_state(spark, run)


_TRIES = "SELECT user_id, (floor(value) % 8)::BIGINT::VARCHAR AS kind, event_type = 'purchase' AS sent, ts AS tried FROM events WHERE event_type IN ('purchase', 'error')"


@query(f"""WITH t AS (SELECT *, lag(sent) OVER w AS was_sent, lag(tried) OVER w AS was, lead(tried) OVER w AS later FROM ({_TRIES}) WINDOW w AS (PARTITION BY user_id, kind ORDER BY tried, sent DESC))
SELECT user_id, kind, 'expired' AS what, epoch_us(tried + INTERVAL 7 DAY) AS at_us FROM t WHERE NOT sent AND coalesce(later > tried + INTERVAL 7 DAY , tried + INTERVAL 7 DAY <= (SELECT max(tried) FROM t) - INTERVAL 1 DAY)
UNION ALL SELECT user_id, kind, 'sent', epoch_us(tried) FROM t WHERE sent AND NOT was_sent AND tried - was <= INTERVAL 7 DAY""")
def r4_owed_deliveries(spark, sf):
    """R4 in the stream: a failed delivery waits for its next try, which keeps it; after seven days without one it goes. Tries come in three slices of days."""
    folder = _folder(spark)
    e = t(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    e = e.select("user_id", (F.floor("value") % 8).cast("bigint").cast("string").alias("kind"), F.when(F.col("event_type") == "purchase", "sent").otherwise("error").alias("status"), "ts", F.col("ts").cast("date").alias("day"))

    def run():
        for stream in _arriving(spark, e, "day", 3, f"{folder}/tries"):
            out = jobs.drained(standings.owed_deliveries(stream, "ts", "1 day"), folder)
        return out.select("user_id", "kind", "what", "at_us")

    return _with_state(spark, run)


@query("SELECT user_id, event_type, 1::BIGINT AS times FROM events WHERE event_type <> 'error' GROUP BY ALL")
def r3_sent_once(spark, sf):
    """Deliveries through the log: a key that was sent is not sent again in a later batch, a failed one is tried again."""
    folder = _folder(spark)
    e = t(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    send = lambda df: df.withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("sent"))
    each = jobs.deliver_unsent(f"{folder}/log", ["user_id", "event_type"], send)
    for stream in _arriving(spark, e, "day", 3, f"{folder}/events"):
        jobs.each_batch(stream, each, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/log").where("status = 'sent'").groupBy("user_id", "event_type").agg(F.count("*").alias("times"))


@query("SELECT user_id, event_type, 1::BIGINT AS times FROM events GROUP BY ALL")
def r3_once_within_watermark(spark, sf):
    """R3 by watermark: a key that comes again within forty days, as all do here, in the same batch or a later one, passes once."""
    folder = _folder(spark)
    e = t(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    for stream in _arriving(spark, e, "day", 3, f"{folder}/events"):
        out = jobs.drained(jobs.sent_once(stream, ["user_id", "event_type"], "day", "40 days"), folder)
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("times"))


def _digested(spark, sf) -> str:
    """Runs the digests of three slices of place changes for ten fans each of whom follows a tenth of the users; those of every third
    fan cannot be sent in the first run. Every seventh user is not resolved."""
    folder = _folder(spark)
    steps = _once(spark, _chain(spark, sf).withColumnRenamed("user_id", "athlete").withColumn("resolved", F.col("athlete") % 7 != 0))
    fans = t(spark, sf, "events").select((F.col("user_id") % 10).alias("fan"), F.col("user_id").alias("athlete")).distinct()
    each = jobs.digest_run(folder, fans, lambda number: F.lit(number > 0) | (F.col("fan") % 3 != 0))
    for stream in _arriving(spark, steps, "period", 3, f"{folder}/changes"):
        jobs.each_batch(stream, each, f"{folder}/checkpoint")
    return folder


_SLICED = f"""SELECT *, user_id % 10 AS fan, dense_rank() OVER (ORDER BY period) - 1 AS nth, count(DISTINCT period) OVER () AS days FROM
  (SELECT user_id, period, lag(place) OVER (PARTITION BY user_id ORDER BY period) AS f, place AS t FROM ({SNAPSHOTS})) WHERE f <> t"""
# Slice i of 3 begins at day floor(i * days / 3).
_BATCHED = f"SELECT *, (nth >= days // 3)::INT + (nth >= 2 * days // 3)::INT AS batch FROM ({_SLICED})"


@query(f"""WITH c AS (SELECT fan, CASE WHEN fan % 3 = 0 THEN greatest(batch, 1) ELSE batch END AS batch, user_id, arg_min(f, period) AS f, arg_max(t, period) AS t FROM ({_BATCHED}) WHERE user_id % 7 <> 0 GROUP BY ALL HAVING f <> t)
SELECT fan, batch, count(*) AS n_items, string_agg(user_id || ': ' || f || ' > ' || t, chr(10) ORDER BY user_id) AS body FROM c GROUP BY fan, batch""")
def r5_digest_batches(spark, sf):
    """Changes composed with what is pending (D5), one digest per fan and run (A10), told once (R3), the unsent kept."""
    folder = _digested(spark, sf)
    return spark.read.schema(jobs.RUN).parquet(f"{folder}/log").where("status = 'sent'").select("fan", F.col("batch").cast("bigint").alias("batch"), "n_items", "body")


@query(f"""WITH b AS ({_BATCHED}), n AS (SELECT batch, count(DISTINCT user_id) FILTER (user_id % 7 <> 0) AS resolved, count(DISTINCT user_id) FILTER (user_id % 7 = 0) AS skipped FROM b GROUP BY batch),
  c AS (SELECT fan, CASE WHEN fan % 3 = 0 THEN greatest(batch, 1) ELSE batch END AS batch, user_id FROM b WHERE user_id % 7 <> 0 GROUP BY ALL HAVING arg_min(f, period) <> arg_max(t, period)),
  first AS (SELECT count(DISTINCT fan) AS n FROM (SELECT fan, user_id FROM b WHERE batch = 0 AND fan % 3 = 0 AND user_id % 7 <> 0 GROUP BY ALL HAVING arg_min(f, period) <> arg_max(t, period)))
SELECT n.batch::BIGINT AS batch, resolved, skipped, (SELECT count(DISTINCT fan) FROM c WHERE c.batch = n.batch) AS sent, CASE n.batch WHEN 0 THEN (SELECT n FROM first) ELSE 0 END::BIGINT AS failed FROM n""")
def r6_run_counters(spark, sf):
    """What each run resolved, skipped, sent and failed to send."""
    folder = _digested(spark, sf)
    return spark.read.schema(jobs.COUNTERS).parquet(f"{folder}/counters").select(F.col("batch").cast("bigint").alias("batch"), "resolved", "skipped", "sent", "failed")


_BROKEN = "hash_of % 11 = 3"
_LANDED = f"SELECT *, (key::BIGINT * 7 + day(period::DATE)) AS hash_of FROM ({_STANDINGS})"


@query(f"""WITH l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS f_{c}" for c in standings.COMPARED)}, last_value(results IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had, row_number() OVER w AS place
  FROM ({_LANDED}) WHERE NOT {_BROKEN} WINDOW w AS (PARTITION BY key ORDER BY period)), n AS (SELECT count(*) AS rows, count(*) FILTER ({_BROKEN}) AS broken FROM ({_LANDED}))
SELECT 'rows' AS what, rows AS n FROM n UNION ALL SELECT 'broken', broken FROM n UNION ALL SELECT 'result', coalesce(sum(len(list_filter(results, lambda x: NOT list_contains(coalesce(had, []), x)))), 0)::BIGINT FROM l WHERE place > 1
""" + "\n".join(f"UNION ALL SELECT '{c}', count(*) FROM l WHERE f_{c} <> {c}" for c in standings.COMPARED))
def r6_broken_rows(spark, sf):
    """Landed lines of which some are cut off and some hold a word for a number. They are counted as the stream runs, and skip their own
    snapshot only: the key's next good one is compared with its last good one."""
    folder = _folder(spark)
    s = _standings(spark, sf)
    nth = F.col("key").cast("bigint") * 7 + F.dayofmonth("period")
    line = F.to_json(F.struct(*s.columns))
    odd = F.when(nth % 2 == 0, F.substring(line, 1, 40)).otherwise(F.regexp_replace(line, '"world":[0-9]+', '"world":"first"'))
    s = s.select(F.col("period").alias("day"), F.when(nth % 11 == 3, odd).otherwise(line).alias("value"))
    counted: dict[str, int] = {}

    def run():
        for _ in _landing(s, "day", 3, f"{folder}/lines", "text"):
            good = cadences.landed(spark, f"{folder}/lines", f"key string, {standings.STANDING}, results array<string>")
            out = jobs.drained(standings.standing_changes(good), folder, counted=counted)
        return out

    changes = _with_state(spark, run)
    told = spark.createDataFrame([(k, counted[k]) for k in ("rows", "broken")], "what string, n bigint")
    kinds = spark.createDataFrame([(k,) for k in (*standings.COMPARED, "result")], "what string")
    return told.unionByName(kinds.join(changes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n")), "what", "left").select("what", F.coalesce("n", F.lit(0)).alias("n")))


def _cadences(spark, sf):
    """Runs over three slices of a stream of standings: ten fans follow a tenth of the users each; even users are women. Fans wish no scores if 4 divides their
    number; every third fan's digests cannot be sent in the first run."""
    folder = _folder(spark)
    s = _standings(spark, sf)
    w = Window.partitionBy("key").orderBy("period")
    fields = F.array(*[F.struct(F.lit(c).alias("kind"), F.lag(c).over(w).cast("bigint").alias("from_value"), F.col(c).cast("bigint").alias("to_value")) for c in standings.COMPARED if c != "qualified"])
    rows = s.select(F.col("key").cast("bigint").alias("athlete"), F.col("period").cast("date").alias("day"), "world", F.lag("period").over(w).isNotNull().alias("advanced"), fields.alias("f"), "results")
    gender = F.when(F.col("athlete") % 2 == 0, "women").otherwise("men")
    moved = rows.select("athlete", "day", F.explode("f").alias("x")).select("athlete", "day", "x.*", F.lit(None).cast("string").alias("item")).where("from_value <> to_value")
    texts = lambda df, kind, item: df.select("athlete", "day", F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("from_value"), F.lit(None).cast("bigint").alias("to_value"), item.alias("item"))
    news = texts(rows.where("advanced"), "result", F.explode("results"))
    standing = texts(rows.where("advanced"), "standing", F.concat(F.lit("stands at "), F.col("world").cast("string")))
    changes = _once(spark, moved.unionByName(news).unionByName(standing).withColumn("gender", gender))
    prefs = F.map_from_arrays(F.array(F.lit("score")), F.array(F.col("fan") % 4 != 0))
    follows = s.select(F.col("key").cast("bigint").alias("athlete")).distinct().withColumn("fan", F.col("athlete") % 10).select("fan", "athlete", gender.alias("gender"), prefs.alias("prefs"))
    each = cadences.cadence_run(folder, follows, lambda number: F.lit(number > 0) | (F.col("fan") % 3 != 0), keep_days=14)  # the runs are ten days apart
    for stream in _arriving(spark, changes, "day", 3, f"{folder}/changes"):
        jobs.each_batch(stream, each, f"{folder}/checkpoint")
    return folder


# In batch i of 3 the days from floor(i * days / 3) on. The first run's digests of every third fan join those of the second.
_RUNS = f"""SELECT *, CASE WHEN fan % 3 = 0 THEN greatest(batch, 1) ELSE batch END AS run FROM (SELECT *, key::BIGINT AS athlete, key::BIGINT % 10 AS fan, CASE WHEN key::BIGINT % 2 = 0 THEN 'women' ELSE 'men' END AS gender, (rank >= days // 3)::INT + (rank >= 2 * days // 3)::INT AS batch FROM
  (SELECT *, dense_rank() OVER (ORDER BY period) - 1 AS rank, lag(world) OVER w AS f_world, lag(european) OVER w AS f_european, lag(score) OVER w AS f_score, count(DISTINCT period) OVER () AS days FROM ({_STANDINGS}) WINDOW w AS (PARTITION BY key ORDER BY period)))"""


@query(f"""WITH r AS (SELECT * FROM ({_RUNS}) WHERE nth > 1),
  moved AS ({" UNION ALL ".join(f"SELECT fan, run, athlete, gender, '{c}' AS kind, arg_min(f_{c}, period)::BIGINT AS f, arg_max({c}, period)::BIGINT AS t FROM r WHERE f_{c} <> {c} {'AND fan % 4 > 0' if c == 'score' else ''} GROUP BY ALL HAVING arg_min(f_{c}, period) <> arg_max({c}, period)" for c in ("world", "european", "score"))}),
  first AS (SELECT fan, athlete, gender, min(run) AS run FROM r GROUP BY ALL),
  intro AS (SELECT fan, run, athlete, gender, arg_max(world, CASE WHEN batch = b THEN period END) AS world FROM (SELECT r.*, min(r.batch) OVER (PARTITION BY r.fan, r.athlete) AS b FROM r JOIN first USING (fan, athlete, run)) GROUP BY ALL),
  lines AS (SELECT DISTINCT 'results' AS digest, fan, run, athlete, 'result' AS kind, unnest(results) AS item FROM r
    UNION ALL SELECT 'ranking:' || gender, fan, run, athlete, 'standing', 'stands at ' || world FROM intro
    UNION ALL SELECT 'ranking:' || gender, fan, run, athlete, kind, kind || ' ' || f || ' > ' || t FROM moved ANTI JOIN intro USING (fan, run, athlete)),
  days AS (SELECT batch, max(period) AS today FROM ({_RUNS}) GROUP BY batch),
  weeks AS (SELECT batch, 'ranking:' || gender AS digest, max(period) AS week FROM r GROUP BY ALL)
SELECT fan, run::BIGINT AS batch, lines.digest, coalesce(week, today)::VARCHAR AS period, count(DISTINCT athlete) AS n_athletes, count(*) AS n_items, string_agg(athlete || ': ' || item, chr(10) ORDER BY athlete, kind, item) AS body
FROM lines JOIN days ON days.batch = run LEFT JOIN weeks ON weeks.batch = run AND weeks.digest = lines.digest GROUP BY ALL""")
def r5_cadences(spark, sf):
    """Results of the day and a ranking digest for each gender's list, each told once per period; what could not be sent joins the next run's;
    preferences (P13) and the introduction that stands in for the changes of an athlete newly followed (D6)."""
    log = spark.read.schema(cadences.LOG).parquet(f"{_cadences(spark, sf)}/log")
    return log.where("status = 'sent'").select("fan", F.col("batch").cast("bigint").alias("batch"), "digest", "period", "n_athletes", "n_items", "body")
