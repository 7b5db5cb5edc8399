"""Keyed state, cadences and broken input, batch by batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from laureate.plans import bindings, change_queries, registry, stream_queries
from laureate.streaming import cadences, jobs, standings

DAY = 86_400_000_000
SNAPSHOT = f"key string, {standings.STANDING}, results array<string>"


@pytest.fixture
def keyed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, standings.STATE_STORE)
    yield spark
    spark.conf.set(name, before)


def _batches(spark, path, batches, schema, job):
    """The rows of a stream over batches that land one after the other."""
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = jobs.drained(job(spark.readStream.schema(df.schema).parquet(f"{path}/in")), f"{path}/job")
    return out


def test_standings_tell_four_kinds_of_change(keyed, tmp_path):
    batches = [
        [("a", "d1", 5, 3, 1000, True, ["x"]), ("b", "d1", 1, None, None, None, None), (None, "d1", 1, 1, 1, True, []), ("a", None, 9, 9, 9, True, [])],
        [("a", "d1", 9, 9, 900, False, ["x", "y"]), ("b", "d2", 2, 7, 500, True, ["p", "q"])],  # no new period for a: results only
        [("a", "d3", 4, None, 950, True, ["z", "y"]), ("a", "d2", 4, 9, 900, False, None), ("b", "d3", 2, 7, 501, None, [])],  # a's come in order of period
        [("a", "d2", 7, 1, 950, True, ["x", "z"]), ("b", "d4", None, 8, 501, False, ["p"])],  # an older period is another period
        [("b", "d5", 3, 8, 501, True, None), ("a", "d2", 1, 1, 1, False, ["z"])],
    ]
    got = sorted(tuple(r)[0:3] + ((r["from_value"], r["to_value"]) if r["item"] is None else (r["item"],)) for r in _batches(keyed, str(tmp_path), batches, SNAPSHOT, standings.standing_changes).collect())
    assert got == sorted([
        ("a", "d1", "result", "y"), ("b", "d2", "world", 1, 2), ("b", "d2", "result", "p"), ("b", "d2", "result", "q"),
        ("a", "d2", "world", 9, 4), ("a", "d3", "score", 900, 950), ("a", "d3", "qualified", 0, 1), ("a", "d3", "result", "z"), ("b", "d3", "score", 500, 501),
        ("a", "d2", "world", 4, 7), ("a", "d2", "result", "x"), ("b", "d4", "european", 7, 8), ("b", "d4", "result", "p"), ("b", "d5", "qualified", 0, 1),
    ])


def test_owed_deliveries_go_after_seven_days_alone(keyed, tmp_path):
    at = lambda day: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
    batches = [
        [(1, "r", "error", at(1)), (2, "r", "error", at(1)), (3, "r", None, at(1)), (None, "r", "error", at(1)), (5, "r", "sent", at(2)), (6, "r", "error", at(3))],
        [(2, "r", "error", at(7)), (3, "r", "sent", at(7.5))],  # 2 is tried again and stays, 3 is sent
        [(2, "r", "error", at(13.5)), (9, "r", "sent", at(14))],  # 1 went on day 8
        [(2, "r", "sent", at(20)), (6, "r", "error", at(20)), (9, "r", "sent", at(30))],
    ]
    out = _batches(keyed, str(tmp_path), batches, "user_id long, kind string, status string, ts timestamp", lambda s: standings.owed_deliveries(s, "ts", "1 day")).collect()
    day = lambda us: (us - int(at(0).replace(tzinfo=datetime.UTC).timestamp() * 1e6)) / DAY
    assert sorted((r["user_id"], r["what"], day(r["at_us"]), r["tries"]) for r in out) == [(1, "expired", 8.0, 1), (2, "sent", 20.0, 3), (3, "sent", 7.5, 1), (6, "expired", 10.0, 1), (6, "expired", 27.0, 1)]


CHANGE = "athlete long, gender string, day date, kind string, from_value long, to_value long, item string"


def test_cadences(spark, tmp_path):
    day = lambda d: datetime.date(2024, 1, d)
    folder = str(tmp_path)
    follows = spark.createDataFrame([(1, 10, "men", None), (1, 20, "women", {"place": False}), (2, 10, "men", {"result": False}), (3, 10, "men", None)], "fan long, athlete long, gender string, prefs map<string,boolean>")
    runs = {
        0: [(10, "men", day(1), "world", 5, 3, None), (10, "men", day(1), "result", None, None, "8.10"), (10, "men", day(1), "standing", None, None, "3rd"), (20, "women", day(1), "world", 9, 8, None), (20, "women", day(1), "score", 900, 950, None)],
        1: [(10, "men", day(2), "world", 3, 5, None), (10, "men", day(2), "result", None, None, "8.10"), (10, "men", day(2), "result", None, None, "8.20"), (20, "women", day(2), "score", 950, 970, None)],
        2: [(10, "men", day(2), "score", 1, 2, None), (10, "men", day(3), "result", None, None, "8.30")],
        3: [(20, "women", day(12), "score", 970, 980, None)],
    }
    sendable = lambda n: {0: F.col("fan") != 2, 1: F.col("fan") != 3}.get(n, F.lit(True))
    each = cadences.cadence_run(folder, follows, sendable, lambda n: F.lit(n == 0) | (F.col("fan") != 3))
    once = None
    for number, rows in runs.items():
        for _ in range(2):  # a batch that runs again gives the same
            each(spark.createDataFrame(rows, CHANGE), number)
        once = sorted((r["batch"], r["fan"], r["digest"], str(r["period"])[-2:], r["status"], r["body"]) for r in spark.read.schema(cadences.LOG).parquet(f"{folder}/log").collect())
    assert once == [
        (0, 1, "ranking:men", "01", "sent", "10: 3rd"), (0, 1, "ranking:women", "01", "sent", "20: score 900 > 950"), (0, 1, "results", "01", "sent", "10: 8.10"),
        (0, 2, "ranking:men", "01", "error", "10: 3rd"), (0, 3, "ranking:men", "01", "sent", "10: 3rd"), (0, 3, "results", "01", "sent", "10: 8.10"),
        (1, 1, "ranking:men", "02", "sent", "10: world 3 > 5"), (1, 1, "ranking:women", "02", "sent", "20: score 950 > 970"), (1, 1, "results", "02", "sent", "10: 8.10\n10: 8.20"),
        (1, 2, "ranking:men", "02", "sent", "10: 3rd"),  # moved and moved back; the introduction is still owed
        (2, 1, "results", "03", "sent", "10: 8.30"),  # the men's list has no new day
        (3, 1, "ranking:women", "12", "sent", "20: score 970 > 980"),
    ]
    assert spark.read.schema(cadences.OUTBOX).parquet(f"{folder}/outbox").where("batch = 1").count() == 0


def test_parked_digests_of_those_who_left(spark, tmp_path):
    """Parked for a fan who is not written to for a while: told on return within seven days, gone after that."""
    day = lambda d: datetime.date(2024, 1, d)
    follows = spark.createDataFrame([(1, 10, "men", None)], "fan long, athlete long, gender string, prefs map<string,boolean>")
    for back, days, want in ((8, [1, 4, 8], ["10: world 5 > 2"]), (9, [1, 5, 9], ["10: world 3 > 2"])):
        folder = f"{tmp_path}/{back}"
        each = cadences.cadence_run(folder, follows, lambda n: F.lit(n > 0), lambda n: F.lit(n != 1))
        for n, (d, step) in enumerate(zip(days, [(5, 3), (7, 7), (3, 2)], strict=True)):
            each(spark.createDataFrame([(10, "men", day(d), "world", *step, None)], CHANGE), n)
        assert [r["body"] for r in spark.read.schema(cadences.LOG).parquet(f"{folder}/log").where("status = 'sent'").collect()] == want


def test_broken_lines_are_counted_and_skip_their_own_snapshot(keyed, tmp_path):
    lines = ['{"key":"a","period":"d1","world":5}', '{"key":"b","period":"d1","world":5}', '{"key":"a","period":"d2","wor', '{"key":"b","period":"d2","world":"five"}', "", '{"key":"a","period":"d3","world":2}']
    keyed.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/in")
    counted = {}
    out = jobs.drained(standings.standing_changes(cadences.landed(keyed, f"{tmp_path}/in", SNAPSHOT)), f"{tmp_path}/job", counted=counted)
    assert [tuple(r)[:5] for r in out.collect()] == [("a", "d3", "world", 5, 2)]
    assert counted["broken"] == 2 and counted["rows"] == 5


@pytest.mark.parametrize("name", ["r5_digest_batches", "r5_cadences"])
def test_snapshots_are_computed_once(spark, sf_dir, monkeypatch, name):
    """Slices, runs and followers read what is written: each row of the snapshots is made once."""
    made = spark.sparkContext.accumulator(0)

    def seen(_):
        made.add(1)
        return True

    passes = F.udf(seen, "boolean").asNondeterministic()
    for plan in (change_queries, stream_queries):
        monkeypatch.setattr(plan, "snapshots", lambda spark, sf: bindings.snapshots(spark, sf).where(passes("user_id")))
    assert registry.queries()[name](spark, sf_dir).count() > 0
    assert made.value == bindings.snapshots(spark, sf_dir).count()
