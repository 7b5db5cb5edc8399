"""Readers and writers over landed files."""

import json

import pytest
from pyspark.sql import functions as F

from laureate.functions.exprs import parse_mark
from laureate.sources import readers, writers


def test_event_groups(spark, tmp_path):
    g = {"label": "10,000m", "gender": "men", "mainEvent": "10000m", "similarEvents": ["10km"], "slug": "10000m", "disciplines": ["10000 Metres"]}
    (tmp_path / "g.json").write_text(json.dumps({"groups": [g, {**g, "slug": "100m"}]}))
    rows = {r["slug"]: r for r in readers.event_groups(spark, str(tmp_path / "g.json")).collect()}
    assert rows["10000m"]["window_months"] == 18 and rows["100m"]["window_months"] == 12 and rows["100m"]["counting_results"] == 5
    (tmp_path / "bad.json").write_text(json.dumps({"groups": [{**g, "disciplines": []}]}))
    with pytest.raises(Exception, match="without slug or disciplines"):
        readers.event_groups(spark, str(tmp_path / "bad.json")).collect()


def test_ladders_and_placing_tables(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"slug": "high-jump", "gender": "men", "column": "HJ", "marks": {"2.30": 1200, "2.31": 1210, "-": 5}}))
    rows = readers.ladders(spark, str(tmp_path / "l.json"), parse_mark).orderBy("mark_c").collect()
    assert [(r["mark_c"], r["points"]) for r in rows] == [(230, 1200), (231, 1210)]
    (tmp_path / "p.json").write_text(json.dumps({"tables": {"2.1": {"title": "x", "scores": {"OW": {"1": 350, "Q": 20}}}}}))
    rows = readers.placing_tables(spark, str(tmp_path / "p.json")).orderBy("place_key").collect()
    assert [tuple(r) for r in rows] == [("2.1", "OW", "1", 350), ("2.1", "OW", "Q", 20)]


def test_rewrite_drops_stale_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, slug string")
    writers.rewrite(df, path, ["slug"])
    writers.rewrite(df.where("slug = 'a'"), path, ["slug"])
    assert [r["slug"] for r in spark.read.parquet(path).collect()] == ["a"]


def test_snapshot_store_keeps_what_was_not_read(spark, tmp_path):
    s = writers.SnapshotStore(spark, str(tmp_path / "s"), "k int, place int, results array<string>", ["k"], ["results"])
    s.upsert(spark.createDataFrame([(1, 5, ["x"]), (2, 6, [])], "k int, place int, results array<string>"))
    out = s.upsert(spark.createDataFrame([(1, None, None), (3, 1, ["z"])], "k int, place int, results array<string>"))
    assert {r["k"]: (r["place"], r["results"]) for r in out.collect()} == {1: (None, ["x"]), 2: (6, []), 3: (1, ["z"])}


def test_pages_round_trip(spark):
    rows = spark.createDataFrame([("h", i) for i in range(7)], "slug string, id int")
    paged = readers.page_of(rows, [F.col("id")], 3, ["slug"])
    assert {r["page"]: r["count"] for r in paged.groupBy("page").count().collect()} == {1: 3, 2: 3, 3: 1}


def test_log_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "daily", "sent")], "user_id int, kind string, status string")
    writers.append_log(df, str(tmp_path / "log"))
    writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_placing_routes_with_default(spark, tmp_path):
    tables = {"10000m": {"final": "2.9", "beforeFinal": {"max9": "2.3"}, "byDiscipline": {"10 Kilometres Road": {"final": "2.10"}}}, "5000m": {"final": "2.5", "beforeFinal": {"OW": "2.6", "max9": "2.7"}}, "default": {"final": "2.2", "beforeFinal": {"min10": "2.4"}}}
    (tmp_path / "r.json").write_text(json.dumps({"eventGroupTables": tables}))
    groups = spark.createDataFrame([("10000m",), ("5000m",), ("hj",)], "slug string")
    got = {tuple(r) for r in readers.placing_routes(spark, str(tmp_path / "r.json"), groups).collect()}
    assert got == {
        ("10000m", "final", "group", None, "2.9"), ("10000m", "before_final", "size", "max9", "2.3"), ("10000m", "final", "discipline", "10 Kilometres Road", "2.10"), ("5000m", "final", "group", None, "2.5"),
        ("5000m", "before_final", "category", "OW", "2.6"), ("5000m", "before_final", "size", "max9", "2.7"), ("hj", "final", "group", None, "2.2"), ("hj", "before_final", "size", "min10", "2.4"),
    }


def test_snapshot_store_goes_on_after_a_restart(spark, tmp_path):
    store = lambda: writers.SnapshotStore(spark, str(tmp_path / "s"), "k int, place int", ["k"])
    store().upsert(spark.createDataFrame([(1, 5)], "k int, place int"))
    out = store().upsert(spark.createDataFrame([(2, 6)], "k int, place int"))
    assert {r["k"]: r["place"] for r in out.collect()} == {1: 5, 2: 6} and store().version == 2


def test_projection_of_one_table(spark, tmp_path):
    combined = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "slug string, x int, y int")
    writers.project_one(combined, str(tmp_path / "one"), "slug = 'b'", ["x"])
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "one")).collect()] == [(3,)]


def test_mark_specs(spark, tmp_path):
    g = {"label": "x", "gender": "women", "mainEvent": "Pole Vault", "similarEvents": [], "slug": "a", "disciplines": ["x"]}
    (tmp_path / "g.json").write_text(json.dumps({"groups": [g, {**g, "slug": "b", "mainEvent": "Discus Throw", "gender": None}, {**g, "slug": "c", "mainEvent": "Decathlon"}]}))
    got = {r["slug"]: (tuple(r["mark"]), r["gender"]) for r in readers.event_groups(spark, str(tmp_path / "g.json")).collect()}
    assert got == {"a": (("height", True, 2, "m"), "women"), "b": (("distance", True, 2, "m"), "women"), "c": (("time", False, 2, "s"), "women")}


def test_one_ladder_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("hj", "men", "HJ", "2.30", 1200), ("hj", "men", "HJ", "2.31", 1210), ("hj", "men", "HJ", "-", 5), ("100m", "women", "100m", "10.90", 1150), ("100m", "women", "100m", "10.85", 1160), ("hj", "women", "HJ", "2.00", 1180)]
    df = spark.createDataFrame(rows, "slug string, gender string, column string, mark string, points int")
    writers.ladder_chunks(df.unionByName(df.limit(1).withColumn("slug", F.lit("gone"))), path)
    writers.ladder_chunks(df, path)  # the folder of the ladder that is gone goes too
    groups = spark.createDataFrame([("hj", "men", (True,)), ("hj", "women", (True,)), ("100m", "women", (False,))], "slug string, gender string, mark struct<better_is_higher: boolean>")
    every = readers.ladders(spark, path, parse_mark, groups).collect()
    assert sorted((r["slug"], r["gender"], r["mark_c"], r["points"], r["best"]) for r in every) == [
        ("100m", "women", 1085, 1160, 1), ("100m", "women", 1090, 1150, 2), ("hj", "men", 230, 1200, 2), ("hj", "men", 231, 1210, 1), ("hj", "women", 200, 1180, 1),
    ]
    one = readers.ladders(spark, path, parse_mark, groups).where("slug = 'hj' and gender = 'men'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slug" in plan and one.select(F.input_file_name()).distinct().count() == 1 and one.count() == 2


def test_chunks_that_differ(spark):
    rows = lambda *r: spark.createDataFrame(r, "slug string, gender string, mark_c long, points int")
    a = rows(("a", "men", 1, 1), ("a", "men", 2, 2), ("b", "men", 1, 1), ("c", "men", 1, 1), ("a", "women", 5, 5))
    b = rows(("a", "men", 2, 2), ("a", "men", 1, 1), ("b", "men", 1, 2), ("d", "men", 1, 1), ("a", "women", 5, 5))
    assert sorted(map(tuple, writers.chunk_differences(a, b).collect())) == [("b", "men", "disagrees"), ("c", "men", "missing"), ("d", "men", "stale")]
