"""Literal cases, randomised equivalences and plan shapes."""

import decimal
import random

import pytest
from pyspark.sql import functions as F

from laureate.functions import exprs as X
from laureate.operators import changes, counting, extract, lookup, quota, rounds, scenarios, scoring, slices


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recount_fills_freed_slots(spark):
    scores = [1378, 1329, 1319, 1275, 1271]
    c = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "a int, k int, score int")
    subs = spark.createDataFrame([(1, 9, 1236, 1)], "a int, k int, score int, substitute_rank int")
    assert counting.ranking_score(c, ["a"], "score").first()["ranking_score"] == 1314
    out = counting.recount(c, subs, c.where("score = 1271"), ["a"], ["k"], "score").first()
    assert (out["ranking_score"], out["n_counting"]) == (1307, 5)


def test_one_more_result_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(900, 1400) for _ in range(rng.randint(1, 5))], rng.randint(900, 1400)) for i in range(500)]
    base = spark.createDataFrame([(i, len(s), sum(s), min(s), x) for i, s, x in rows], "id int, n_counting int, sum_score long, cap long, added long")
    got = {r["id"]: r["new_score"] for r in counting.with_one_more(base, "added").collect()}
    for i, s, x in rows:
        best = sorted([*s, x], reverse=True)[:5]
        assert got[i] == sum(best) // len(best)


def test_ties_do_not_count(spark):
    base = spark.createDataFrame([(5, 5000, 900, 900)], "n_counting int, sum_score long, cap long, added long")
    assert counting.with_one_more(base, "added").first()["counts"] is False


def test_cap_is_inclusive(spark):
    pool = spark.createDataFrame([(1, 1, 50), (1, 2, 40), (1, 3, 40), (1, 4, 41)], "a int, k int, score int")
    c, caps = pool.where("k in (1, 2)"), spark.createDataFrame([(1, 40)], "a int, cap int")
    assert [r["k"] for r in counting.substitutes(pool, c, caps, ["a"], ["k"], [F.col("k")], "score").collect()] == [3]


def test_quota_equals_walk(spark):
    rng = random.Random(2)
    pool, pre = [], []
    for e in range(60):
        free = {c: rng.randint(0, 4) for c in "ABCDE"}
        pre += [(e, c, n) for c, n in free.items() if n]
        pool += [(e, rng.choice("ABCDE"), a, rng.randint(0, 30)) for a in range(20)]
    p = spark.createDataFrame(pool, "event int, country string, athlete int, score int")
    q = spark.createDataFrame(pre, "event int, country string, pre int")
    got = {(r["event"], r["athlete"]): r["pool_rank"] for r in quota.quota_rank(p, q, ["event"], [F.col("score").desc(), F.col("athlete")]).collect()}
    huge = quota.quota_rank_huge(p.withColumn("pos", -F.col("score") * 1000 + F.col("athlete")), q, ["event"], "pos", slices=3)
    assert {(r["event"], r["athlete"]): r["pool_rank"] for r in huge.collect()} == {k: v for k, v in got.items() if v is not None}
    for e in range(60):
        used, n = {c: x for ev, c, x in pre if ev == e}, 0
        for _, c, a, s in sorted((x for x in pool if x[0] == e), key=lambda x: (-x[3], x[2])):
            if used.get(c, 0) >= 3:
                assert got[e, a] is None
            else:
                used[c] = used.get(c, 0) + 1
                n += 1
                assert got[e, a] == n


def test_quota_place_equals_walk(spark):
    rng = random.Random(3)
    pool, pre, asks = [], {}, []
    for e in range(40):
        for c in "ABCD":
            if n := rng.randint(0, 4):
                pre[e, c] = n
        pool += [(e, rng.choice("ABCD"), rng.randint(0, 20)) for _ in range(rng.randint(0, 15))]
        asks += [(e, rng.choice("ABCD"), e * 10 + i, rng.randint(0, 22)) for i in range(5)]
    out = scenarios.quota_place(
        spark.createDataFrame(asks, "event int, country string, id int, ask int"), spark.createDataFrame(pool, "event int, country string, score int"),
        spark.createDataFrame([(*k, v) for k, v in pre.items()], "event int, country string, pre int"), ["event"], "ask",
    )
    got = {r["id"]: r for r in out.collect()}
    for e, c, i, s in asks:
        used, place, ahead = {k[1]: v for k, v in pre.items() if k[0] == e}, 0, [x for x in pool if x[0] == e and x[2] > s]
        for _, pc, _ in sorted(ahead, key=lambda x: -x[2]):
            if used.get(pc, 0) < 3:
                used[pc] = used.get(pc, 0) + 1
                place += 1
        want = None if used.get(c, 0) >= 3 else place + 1
        assert got[i]["quota_place"] == want and got[i]["uncapped_place"] == len(ahead) + 1
    assert "CartesianProduct" not in _plan(out) and "NestedLoop" not in _plan(out)


def test_chain_equals_fold(spark):
    rng = random.Random(4)
    steps = []
    for k in range(200):
        at = rng.randint(0, 3)
        for s in range(rng.randint(1, 6)):
            to = rng.randint(0, 3)
            if to != at:
                steps.append((k, s, at, to))
            at = to
    df = spark.createDataFrame(steps, "k int, seq int, from_value int, to_value int")
    got = {r["k"]: (r["from_value"], r["to_value"]) for r in changes.composed_chain(df, ["k"], "seq").collect()}
    for k in range(200):
        own = [x for x in steps if x[0] == k]
        want = (own[0][2], own[-1][3]) if own and own[0][2] != own[-1][3] else None
        assert got.get(k) == want


def test_marks_and_dates(spark):
    df = spark.createDataFrame([("1:02.50", "16 SEP 2025"), ("DNF", "2025-09-16T10:00"), ("8.95w", "31 FEB 2025"), ("1:2:3:4", None), ("2:05:10", "x"), ("8.95 (w)", "x"), ("6,234", "x"), ("1.2.3", "x"), ("—", "x"), ("5:", "x")], "m string, d string")
    got = [(r[0] and float(r[0]), r[1] and str(r[1])) for r in df.select(X.parse_mark(F.col("m")), X.parse_date(F.col("d"))).collect()]
    assert got == [(62.5, "2025-09-16"), (None, "2025-09-16"), (8.95, None), (None, None), (7510.0, None), (8.95, None), (6234.0, None), (None, None), (None, None), (300.0, None)]


def test_window_ends_and_allowance(spark):
    df = spark.sql("select date'2026-08-31' r, date'2025-02-28' a, date'2024-01-01' g")
    end, start = F.col("r"), X.window_start(F.col("r"), F.lit(18))
    r = df.select(start.alias("s"), X.eligible(F.col("a"), F.lit("OW"), start, end, "GL").alias("i"), X.eligible(F.col("g"), F.lit("GL"), start, end, "GL").alias("area"), X.eligible(F.col("g"), F.lit("GL"), start, end, None).alias("fixed")).first()
    assert (str(r["s"]), r["i"], r["area"], r["fixed"]) == ("2025-02-28", True, True, False)


def test_asof_reaches_saturates_and_misses(spark):
    ladder = spark.createDataFrame([("h", 230, 1200), ("h", 231, 1190), ("h", 240, 1395)], "slug string, mark_c long, points long")
    p = spark.createDataFrame([("h", 230), ("h", 235), ("h", 999), ("h", 100), ("x", 5)], "slug string, probe long")
    out = scoring.asof_points(p, ladder, ["slug"], F.col("probe"))
    assert {r["probe"]: r["points"] for r in out.collect()} == {230: 1200, 235: 1200, 999: 1395, 100: 0, 5: 0}
    assert "NestedLoop" not in _plan(out) and "CartesianProduct" not in _plan(out)
    other = scoring.asof_points_by_union(p, ladder, ["slug"], F.col("probe"))
    assert {r["probe"]: r["points"] for r in other.collect()} == {230: 1200, 235: 1200, 999: 1395, 100: 0, 5: 0}


def _both_forms(spark, probes, ladder, schema="slug string, mark_c long, points long, higher boolean"):
    """{row: points} of each form; they must agree, and keep every row."""
    rungs = spark.createDataFrame(ladder, schema)
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(probes)], "i int, slug string, probe decimal(14,2)")
    out = [{r["i"]: r["points"] for r in f(p, rungs, ["slug"], F.col("probe"), higher="higher").collect()} for f in (scoring.asof_points, scoring.asof_points_by_union)]
    assert out[0] == out[1] and len(out[0]) == len(probes)
    return [out[0][i] for i in range(len(probes))]


def test_asof_of_times_and_heights(spark):
    D = decimal.Decimal
    ladder = [("t", 987, 1200, False), ("t", 995, 1170, False), ("t", 1010, 1100, False), ("h", 230, 1190, True), ("h", 231, 1200, True), (None, 1, 9, True), ("h", None, 2000, True), ("t", 900, None, False), ("h", 231, 1199, True)]
    probes = [("t", D("990")), ("t", D("980")), ("t", D("1020")), ("t", D("986.5")), ("t", D("987.5")), ("t", D("1010")), ("t", D("1010.25")), ("h", D("230.5")), ("h", D("229.75")), ("h", D("9999")), ("h", None), (None, D("230")), ("x", D("230")), (None, None), ("h", D("230.5"))]
    assert _both_forms(spark, probes, ladder) == [1170, 1200, 0, 1200, 1170, 1100, 0, 1190, 0, 1200, 0, 0, 0, 0, 1190]


def test_asof_of_ladders_that_are_not_monotone(spark):
    rng = random.Random(3)
    ladder = [(s, rng.randrange(3000), rng.randrange(900), s == "h") for s in "ht" for _ in range(300)]
    probes = [(rng.choice("ht"), decimal.Decimal(rng.randrange(-400, 14000)) / 4) for _ in range(400)]
    want = [max([q for s, m, q, up in ladder if s == g and (m <= p if up else m >= p)], default=0) for g, p in probes]
    assert _both_forms(spark, probes, ladder) == want


def test_asof_of_sparse_ladders(spark):
    """Rungs far apart cost no more than near ones: nothing is made for the marks between them."""
    far = 3 * 10**8
    ladder = [("h", i * far, i + 1, True) for i in range(40)] + [("t", -i * far, i + 1, False) for i in range(40)]
    probes = [("h", decimal.Decimal(7 * far + 1)), ("h", decimal.Decimal(-1)), ("t", decimal.Decimal(-5 * far)), ("t", decimal.Decimal(-5 * far) + 1), ("h", decimal.Decimal(900 * far))]
    assert _both_forms(spark, probes, ladder) == [8, 0, 6, 5, 40]
    rungs = spark.createDataFrame(ladder, "slug string, mark_c long, points long, higher boolean")
    plan = _plan(scoring.asof_points(spark.createDataFrame([("h", 5)], "slug string, probe long"), rungs, ["slug"], F.col("probe"), higher="higher"))
    assert "BroadcastHashJoin" in plan and "explode" not in plan and "sequence" not in plan and "NestedLoop" not in plan


def test_asof_beyond_the_broadcast_size(spark, monkeypatch):
    ladder = spark.createDataFrame([("h", i, i) for i in range(50)], "slug string, mark_c long, points long")
    probes = spark.createDataFrame([("h", 7), ("h", 99), (None, 3)], "slug string, probe long")
    monkeypatch.setattr(scoring, "SMALL_LADDER", 20)
    out = scoring.asof_points(probes, ladder, ["slug"], F.col("probe"))
    assert "_slice" in _plan(out) and sorted((str(r["slug"]), r["points"]) for r in out.collect()) == [("None", 0), ("h", 7), ("h", 49)]


def test_nearest_mark_of_times(spark):
    ladder = spark.createDataFrame([(987, 1200), (995, 1170), (1010, 1100), (1011, 1100)], "mark_c long, points long")
    s = spark.createDataFrame([(1185,), (1184,), (1170,), (5,), (9999,), (None,), (1135,), (1185,)], "s int")
    got = scoring.nearest_mark(s, ladder, "s", better_is_higher=False)
    assert sorted((r["s"] or 0, r["mark_c"]) for r in got.collect()) == [(0, None), (5, 1010), (1135, 995), (1170, 995), (1184, 995), (1185, 987), (1185, 987), (9999, 987)]


def test_scenarios_of_times(spark):
    ladder = spark.createDataFrame([("100m", 987, 1200, False), ("100m", 995, 1170, False)], "slug string, mark_c long, points long, higher boolean")
    routes = spark.createDataFrame([("g", "final", "group", None, "2.2")], "grp string, round_kind string, selector_kind string, selector string, table_no string")
    tables = spark.createDataFrame([("2.2", "A", "1", 100)], "table_no string, category string, place_key string, points int")
    s = spark.createDataFrame([("g", "100m", 990, "A", 1), ("g", "100m", 996, "A", 2)], "grp string, slug string, mark_c int, category string, place int")
    got = scoring.scenario_scores(s, ladder, routes, tables, higher="higher").collect()
    assert sorted((r["mark_points"], r["placing_points"], r["score"]) for r in got) == [(0, 0, 0), (1170, 100, 1270)]


def test_series_has_a_column_for_each_category(spark):
    codes = spark.createDataFrame([(c, "1", i) for i, c in enumerate(["A", "GL", "ÖW", None])], "category string, place_key string, points int")
    compared = scoring.category_comparison(spark.createDataFrame([(1, 1000, 1), (2, 900, 2)], "id int, mark_points int, place int"), codes, codes)
    assert {r["mark_points"]: r.asDict() for r in scoring.score_series(compared, prefix="c").collect()} == {
        1000: {"mark_points": 1000, "cA": 1000, "cGL": 1001, "cÖW": 1002}, 900: {"mark_points": 900, "cA": 900, "cGL": 900, "cÖW": 900},
    }


def test_rounds(spark):
    df = spark.createDataFrame([(1, "c", "F1"), (1, "c", "SF2"), (1, "c", "H1"), (1, None, "Q1"), (1, None, "OQ(1)3")], "a int, comp string, race string")
    got = {r["race"]: (r["round_kind"], r["advanced"]) for r in rounds.classify_rounds(df, ["a", "comp"]).collect()}
    assert got == {"F1": ("final", False), "SF2": ("before_final", True), "H1": ("other", True), "Q1": ("before_final", False), "OQ(1)3": ("other", False)}


def test_best_of_round_comes_before_exclusion(spark):
    rows = spark.createDataFrame([(1, 1, 50, 1), (1, 1, 45, 2), (1, 2, 40, 1)], "a int, k int, score int, ord int")
    best = counting.best_per_round(rows, ["a", "k"], "score", ["ord"])
    c = best.where("k = 1")
    caps = spark.createDataFrame([(1, 50)], "a int, cap int")
    assert [r["k"] for r in counting.substitutes(best, c, caps, ["a"], ["k"], [F.col("k")], "score").collect()] == [2]


def test_top_n_prunes_before_the_shuffle(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = _plan(counting.top_n(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]))
    assert "WindowGroupLimit" in plan


def test_empty_tables(spark):
    e = spark.createDataFrame([], "athlete int, comp int, race string, score int, mark_points int, d date")
    assert counting.ranking_score(counting.top_n(e, ["athlete"], [F.col("score")]), ["athlete"], "score").collect() == []
    assert rounds.classify_rounds(e, ["athlete", "comp"]).collect() == []


def test_name_search_finds_parts_of_words(spark):
    names = [(1, "Alina MÜLLER"), (2, "Tom Mu\u0308ller"), (2, "Tom Mu\u0308ller"), (3, "Natalie Xu"), (4, None), (5, "Łukasz Ali")]
    asks = ["ali", "muller", "ÜLL a", "x", "li mul", "xu nat", " ", None, "ali", "zzz"]
    out = lookup.name_hits(spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([(q,) for q in asks], "query string"), "name", "query", [F.col("id")])
    got = sorted((r["query"], r["id"], r["hit"]) for r in out.collect())
    assert got == sorted([("ali", 1, 1), ("ali", 3, 2), ("ali", 5, 3), ("muller", 1, 1), ("muller", 2, 2), ("ÜLL a", 1, 1), ("x", 3, 1), ("li mul", 1, 1), ("xu nat", 3, 1)])
    assert "CartesianProduct" not in _plan(out) and "NestedLoop" not in _plan(out)


def test_name_search_sends_queries_not_names(spark, monkeypatch, tmp_path):
    """Of few names and more queries, by Spark's reckoning, the names' runs of letters would be broadcast."""
    spark.createDataFrame([(i, f"Name {i} of many letters") for i in range(50)], "id int, name string").write.parquet(f"{tmp_path}/names")
    spark.createDataFrame([(f"{i} nam", "x" * 40) for i in range(300)], "query string, note string").write.parquet(f"{tmp_path}/queries")
    names, asks = spark.read.parquet(f"{tmp_path}/names"), spark.read.parquet(f"{tmp_path}/queries")
    found = []
    for few in (300, 0):
        monkeypatch.setattr(lookup, "FEW_QUERIES", few, raising=False)
        out = lookup.name_hits(names, asks, "name", "query", [F.col("id")])
        plan = _plan(out)
        assert ("BuildRight" in plan) == (few == 300) and ("SortMergeJoin" in plan) == (few == 0) and "BuildLeft" not in plan
        found.append(sorted((r["query"], r["id"], r["hit"]) for r in out.collect()))
    want = [(f"{q} nam", i, n + 1) for q in range(300) for n, i in enumerate([i for i in range(50) if str(q) in str(i)][:12])]
    assert found[0] == found[1] == sorted(want)


def test_plans_spread_large_groups(spark):
    """No window over a whole pool or ladder: each is keyed by a slice, a score or a country as well."""
    p = spark.createDataFrame([("e", "A", i, i % 7) for i in range(50)], "event string, country string, athlete int, score int")
    ladder = spark.createDataFrame([("h", i * 3, i) for i in range(40)], "slug string, mark_c long, points long")
    by_union = scoring.asof_points_by_union(spark.createDataFrame([("h", 5)], "slug string, probe long"), ladder, ["slug"], F.col("probe"))
    nearest = scoring.nearest_mark(spark.createDataFrame([(3,), (100,), (None,)], "s int"), ladder, "s")
    assert {r["s"]: r["mark_c"] for r in nearest.collect()} == {3: 9, 100: 117, None: None}
    for df in (quota.uncapped_position(p, ["event"], "score", [F.col("athlete")], F.lit(3), F.lit(1)), quota.projected_place(p, ["event"], "score"), by_union, nearest):
        plan = _plan(df)
        assert "SinglePartition" not in plan and "exchange" in plan.lower()
    assert "_slice" in _plan(by_union) and "_slice" in _plan(nearest)


def test_round_codes_in_any_case(spark):
    codes = {" f1 ": 9, "F": 9, "FN": 0, "sf1": 3, "SF": 3, "H1A": 1, "q": 2, "QX": 2, "OQ(1)3": 0, "": 0, None: 0}
    df = spark.createDataFrame([(c,) for c in codes], "race string")
    assert {r["race"]: r["s"] for r in df.select("race", rounds.round_seniority(F.col("race")).alias("s")).collect()} == codes


def test_families(spark):
    df = spark.createDataFrame([(d,) for d in ("high-jump", "discus", "decathlon", "800m")], "d string")
    got = {r["d"]: r["f"] for r in df.select("d", X.family(F.col("d"), ["high-jump"], ["discus"]).alias("f")).collect()}
    assert got == {"high-jump": "Jumps", "discus": "Throws", "decathlon": "Track", "800m": "Track"}


def _cells(spark, labels, values=None):
    rows = [("t", i, x, [("A", (values or {}).get(i, str(100 - i))), ("B", " ")]) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "table string, row int, label string, cells array<struct<category: string, value: string>>")


def test_placing_labels(spark):
    got = extract.placing_cells(_cells(spark, ["1st", "", "3rd *", "4\u20136th", "10-13th *", "Q or q to Final", None, " "], {2: "70*", 7: ""})).collect()
    want = {"1": 100, "2": 99, "3": 70, "4": 97, "5": 97, "6": 97, **dict.fromkeys(["10", "11", "12", "13"], 96), "Q": 95, "14": 94}
    assert {r["place_key"]: r["points"] for r in got} == want and {r["category"] for r in got} == {"A"}


@pytest.mark.parametrize("labels,message", [(["", "1st"], "without a place before"), (["1st", "final"], "unknown place label"), (["6-4th"], "descending")])
def test_placing_labels_that_fail(spark, labels, message):
    with pytest.raises(Exception, match=message):
        extract.placing_cells(_cells(spark, labels)).collect()


def test_inferred_place_needs_one_before(spark):
    with pytest.raises(Exception, match="without a place before"):
        extract.inferred_places(spark.createDataFrame([(1, 1, None)], "k int, o int, place long"), "k", "o", "place").collect()


def test_tables_with_glued_headers(spark):
    text = "Scoring 2025\nHigh women\n100m 3000m SC 2 Miles Points\n11.0 - 9:10 1200\n- 8:00 9:20 1190\n11.0 8:00 9:30 1180\n1 2 3\n"
    rows = extract.table_rows(spark.createDataFrame([("d", 1, text)], "doc string, page int, text string")).collect()
    assert {(r["section"], r["column"], r["mark"]): r["score"] for r in rows} == {
        ("WOMEN", "100m", "11.0"): 1200, ("WOMEN", "2 Miles", "9:10"): 1200, ("WOMEN", "3000m SC", "8:00"): 1190, ("WOMEN", "2 Miles", "9:20"): 1190, ("WOMEN", "2 Miles", "9:30"): 1180,
    }


def test_long_pages_keep_their_order(spark):
    text = "Men\n" + "x\n" * 100_001 + "Points HJ\n"
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "Points HJ\n1000 2.00")], "doc string, page int, text string")
    assert [(r["section"], r["score"]) for r in extract.table_rows(pages).collect()] == [("MEN", 1000)]


def test_wind_pairs(spark):
    rows = [(["+0.0 m/s", "-0 pts", "-0.0 m/s", "+0 pts"],), (["+1.2 m/s", "-7.2 pts", "-1.2 m/s", ""],), (["+1.2 m/s", "-7.2", " ", "x"],), (["a"],)]
    got = extract.tidy_wind(spark.createDataFrame(rows, "cells array<string>")).collect()
    assert sorted((r["wind"], r["points"]) for r in got) == [(0.0, 0), (1.2, -7)]


def test_events_of_groups(spark):
    events = spark.createDataFrame([(1, "M", "Men's 100 Metres", 0), (2, "M", "Men's 100 Metres Hurdles", 1), (3, "W", "Women's 100 metres", 2), (4, "M", "Men's 100 METRES", 3), (5, "M", "high jump", 4)], "event_id int, gender string, name string, pos int")
    groups = spark.createDataFrame([("100m", "M", ["100 Metres"]), ("hurdles", "M", ["100 Metres", "100 Metres Hurdles"]), ("100m", "W", ["100 METRES"]), ("hj", "M", ["High Jump"]), ("jump", "M", ["Metres Hurdle", "ump"])], "slug string, gender string, disciplines array<string>")
    got = {(r["slug"], r["gender"]): r["event_id"] for r in lookup.events_of_groups(groups, events).collect()}
    assert got == {("100m", "M"): 1, ("hurdles", "M"): 2, ("100m", "W"): 3, ("hj", "M"): 5, ("jump", "M"): None}


def test_counterparts_by_list_position(spark):
    rows = [("men", "110mh", 0), ("men", "decathlon", 1), ("men", "800m", 2), ("women", "100mh", 0), ("women", "heptathlon", 1), ("women", "800m", 2)]
    got = {(r["gender"], r["slug"]): r["counterpart"] for r in lookup.counterparts(spark.createDataFrame(rows, "gender string, slug string, pos int")).collect()}
    assert got["men", "110mh"] == "100mh" and got["women", "heptathlon"] == "decathlon" and got["men", "800m"] == "800m"


def test_placing_routes(spark):
    routes = [("5000m", "final", "group", None, "2.5"), ("5000m", "before_final", "category", "OW", "2.6"), ("5000m", "before_final", "size", "max9", "2.7"), ("hj", "final", "group", None, "2.2"), ("hj", "before_final", "size", "min10", "2.4"), ("10000m", "final", "group", None, "2.9"), ("10000m", "final", "discipline", "10 Kilometres Road", "2.10")]
    tables = [("2.2", "A", "1", 100), ("2.9", "A", "1", 56), ("2.10", "A", "1", 40), ("2.6", "OW", "Q", 60), ("2.6", "OW", "9", 50), ("2.7", "DF", "9", 30), ("2.4", "OW", "11", 20), ("2.5", "OW", "1", 200)]
    rows = [
        ("hj", "High Jump", "final", False, "A", "min10", 1, 100), ("10000m", "10000m", "final", False, "A", "max9", 1, 56), ("10000m", "10 Kilometres Road", "final", False, "A", "max9", 1, 40),
        ("5000m", "5000m", "before_final", True, "OW", "max9", 3, 60), ("5000m", "5000m", "before_final", False, "OW", "max9", 9, 50), ("5000m", "5000m", "before_final", False, "DF", "max9", 9, 30),
        ("5000m", "5000m", "before_final", True, "DF", "max9", 9, 0), ("hj", "High Jump", "before_final", False, "OW", "min10", 11, 20), ("hj", "High Jump", "other", False, "OW", "min10", 1, 0),
        ("hj", "High Jump", "final", False, "F", "min10", 1, 0), ("5000m", "5000m", "final", True, "OW", "max9", 1, 200), ("hj", "High Jump", "final", False, "A", "min10", 99, 0),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "grp string, discipline string, round_kind string, advanced boolean, category string, field_rule string, place int, want int, i int")
    out = scoring.placing_points(df, spark.createDataFrame(routes, "grp string, round_kind string, selector_kind string, selector string, table_no string"), spark.createDataFrame(tables, "table_no string, category string, place_key string, points int"))
    got = out.collect()
    assert len(got) == len(rows) and all(r["placing_points"] == r["want"] for r in got)


def test_many_categories(spark):
    codes = spark.createDataFrame([(f"c{i}", "1", i) for i in range(150)], "category string, place_key string, points int")
    out = scoring.category_comparison(spark.createDataFrame([(1, 1000, 1)], "id int, mark_points int, place int"), codes, codes)
    assert sorted(r["total_score"] for r in out.collect()) == [1000 + i for i in range(150)]


def test_composition_carries_what_is_owed(spark):
    side = lambda rows: spark.createDataFrame(rows, "k int, from_value int, to_value int, intro string")
    got = changes.composed(side([(1, 8, 5, "x"), (2, 4, 2, None), (3, 1, 2, "y"), (5, None, 3, None)]), side([(1, 5, 3, "z"), (2, 2, 4, "w"), (4, 6, 7, "v"), (5, 3, 4, None)]), ["k"], ["intro"]).collect()
    assert {r["k"]: (r["from_value"], r["to_value"], r["intro"]) for r in got} == {1: (8, 3, "x"), 3: (1, 2, "y"), 4: (6, 7, "v")}


def test_ranks_by_histogram(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2, 3, 4])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id int, s int")
    out = quota.rank_by_histogram(df, ["g"], "s", "r")
    for r in out.collect():
        better = sum(g == r["g"] and s is not None and (r["s"] is None or s > r["s"]) for g, _, s in rows)
        assert r["r"] == better + 1


def test_slices_hold_alike_many_and_do_not_depend_on_order(spark):
    rows = [(g, k) for g, n in (("a", 3000), ("b", 3), (None, 40)) for k in (i**3 for i in range(n))] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, k long")
    cut = {(r["g"], r["k"]): r["_slice"] for r in slices.sliced(df, ["g"], "k", 32).collect()}
    again = {(r["g"], r["k"]): r["_slice"] for r in slices.sliced(df.orderBy(F.rand(3)).repartition(5), ["g"], "k", 32).collect()}
    assert cut == again and len(cut) == len(rows)
    assert cut["a", None] == cut["c", None] == -1
    for g in ("a", "b", None):
        at = [cut[x] for x in sorted((x for x in cut if x[0] == g and x[1] is not None), key=lambda x: x[1])]
        assert at == sorted(at) and at[0] >= 0
        most = max(at.count(x) for x in set(at))
        assert most <= (600 if g == "a" else len(at) / 4 + 3)


def test_ranks_of_a_large_group_come_from_slices(spark):
    values = [(i * 7919 % 5003, i) for i in range(4000)] + [(17, 9000), (17, 9001), (None, 9002), (None, 9003)]
    df = spark.createDataFrame([("x", s, i) for s, i in values] + [(None, 5, 1), (None, 9, 2), ("empty", None, 3)], "g string, s long, id long")
    out = quota.rank_by_histogram(df, ["g"], "s", "r", 16)
    got = {(r["g"], r["id"]): r["r"] for r in out.collect()}
    known = sorted((s for s, _ in values if s is not None), reverse=True)
    place = {s: known.index(s) + 1 for s in known}
    assert got == {**{("x", i): place[s] if s is not None else len(known) + 1 for s, i in values}, (None, 1): 2, (None, 2): 1, ("empty", 3): 1}
    own = [line for line in _plan(out).splitlines() if "Window" in line and "_hs" in line and "sum" in line]
    assert own and all("_slice" in line for line in own)


def test_search_keeps_twelve_ranked_first(spark):
    one = lambda ids: spark.createDataFrame([("q", i) for i in ids], "query string, id int")
    out = lookup.with_unranked(one(range(10, 20)), one(range(0, 15)), "id", ["query"], [F.col("id")], 12).collect()
    assert [(r["id"], r["origin"]) for r in sorted(out, key=lambda r: r["hit"])] == [(i, "ranked") for i in range(10, 20)] + [(0, "listed"), (1, "listed")]


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    import datetime

    from laureate.streaming import jobs

    day = lambda d: datetime.datetime(2024, 1, d, 12)
    path = str(tmp_path / "in")
    for rows in ([(day(10), "a", 1), (day(12), "a", 1)], [(day(2), "a", 100), (day(11), "a", 1), (day(20), "a", 1)], [(day(12), "a", 100), (day(25), "a", 1)]):
        df = spark.createDataFrame(rows, "ts timestamp, k string, v long")
        df.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).parquet(path)
        out = jobs.drained(jobs.rolled_up(stream, "ts", "1 day", "2 days", ["k"], "v"), str(tmp_path / "job"))
    assert {(r["start"].day, r["n"], r["total"]) for r in out.collect()} == {(10, 1, 1), (11, 1, 1), (12, 1, 1), (20, 1, 1)}


def test_deliveries_that_run_again(spark, tmp_path):
    from laureate.streaming import jobs

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    down = [True]
    each = jobs.deliver_unsent(str(tmp_path / "log"), ["id"], lambda df: df.withColumn("status", F.when(F.lit(down[0]) & (F.col("id") == 2), "error").otherwise("sent")))
    each(ids(1, 1, 2), 0)
    down[0] = False
    each(ids(1, 2, 3), 1)
    each(ids(1, 2, 3), 1)
    each(ids(3, 4), 2)
    assert sorted((r["id"], r["batch"], r["status"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(1, 0, "sent"), (2, 0, "error"), (2, 1, "sent"), (3, 1, "sent"), (4, 2, "sent")]


def test_marks_by_spec(spark):
    cases = [(987, "time", 2, "9.87"), (10229, "time", 2, "1:42.29"), (744300, "time", 0, "2:04:03"), (5996, "time", 1, "1:00.0"), (230, "height", 2, "2.30 m"), (850000, "points", 0, "8500 points"), (1234, "distance", 3, "12.340 m"), (250, "points", 0, "3 points"), (None, "time", 2, None)]
    df = spark.createDataFrame([(c, (k, d, "points" if k == "points" else "m"), w) for c, k, d, w in cases], "c long, spec struct<kind: string, decimals: int, unit: string>, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", X.mark_text(F.col("c"), F.col("spec")).alias("got")).collect())


def test_counting_replay_tells_what_is_off(spark):
    from laureate.operators import checks

    ours = spark.createDataFrame([(a, i, 100 - i, "in" if i < 7 else "out") for a in range(6) for i in range(9)], "a int, id int, score int, day string")
    row = lambda i, **kw: {"id": i, "official": 100 - i, "day": "in"} | kw
    best = [row(i) for i in range(5)]
    calculations = [(0, 98, best), (1, 98, [*best[:4], row(4, official=97)]), (2, 98, [*best[:4], row(4, day="out")]), (3, 97, best), (4, 97, best[1:] + [row(5)]), (5, 98, best[:3] + [row(3, id=77), row(4)])]
    df = spark.createDataFrame([(a, p, [(r["id"], r["official"], r["day"]) for r in rs]) for a, p, rs in calculations], "a int, published int, results array<struct<id: int, official: int, day: string>>")
    out = checks.counting_replay(ours, df, ["a"], ["id"], "score", F.col("day") == "in", [F.col("score").desc()])
    got = {r["a"]: (r["scores"], r["window"], r["average"], r["selection"]) for r in out.collect()}
    assert got == {0: (True, True, True, True), 1: (False, True, True, True), 2: (True, False, True, True), 3: (True, True, False, True), 4: (True, True, True, False), 5: (False, True, True, False)}
