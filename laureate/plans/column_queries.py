"""Column expressions, sources, searches and facets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import changes as D
from ..operators import checks as K
from ..operators import lookup as L
from ..sources import readers as R
from ..sources import writers as W
from .bindings import LADDER, PLACING, ladder, placing, shared_folder, t
from .registry import query


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS d FROM orders""")
def p1_parse_date(spark, sf):
    o = t(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "O", F.upper(F.date_format("o_orderdate", "d MMM yyyy"))).when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise(F.lit("31 FEB 2020"))
    return o.select("o_orderkey", X.parse_date(text).alias("d"))


@query("""WITH h AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice * 100)::BIGINT % 1000000 AS c FROM orders)
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN c / 100 WHEN 'F' THEN c / 100 END::DECIMAL(14,4) AS mark FROM h""")
def p2_parse_mark(spark, sf):
    """Plain marks with a letter, times of two parts, and texts for no mark."""
    o = t(spark, sf, "orders").withColumn("c", F.round(F.col("o_totalprice") * 100).cast("bigint") % 1_000_000)
    sec = F.concat(F.lpad((F.floor(F.col("c") / 100) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    plain = F.concat(F.floor(F.col("c") / 100).cast("string"), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"), F.lit(" (w)"))
    text = F.when(F.col("o_orderstatus") == "O", plain).when(F.col("o_orderstatus") == "F", F.concat(F.floor(F.col("c") / 6000).cast("string"), F.lit(":"), sec)).otherwise("DNF")
    return o.select("o_orderkey", X.parse_mark(text).alias("mark"))


@query("""WITH h AS (SELECT o_orderkey, o_orderstatus = 'F' AS is_time, round(o_totalprice * 100)::BIGINT % 1000000 AS c FROM orders)
SELECT o_orderkey, CASE WHEN NOT is_time OR c < 6000 THEN printf('%d.%02d', c // 100, c % 100) WHEN c < 360000 THEN printf('%d:%02d.%02d', c // 6000, c // 100 % 60, c % 100)
  ELSE printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) END AS text, (c // 100)::BIGINT AS whole, (c % 100)::BIGINT AS low, c AS back FROM h""")
def p3_p15_marks(spark, sf):
    """Marks as text, as digit groups, and back."""
    o = t(spark, sf, "orders").withColumn("c", F.round(F.col("o_totalprice") * 100).cast("bigint") % 1_000_000).withColumn("is_time", F.col("o_orderstatus") == "F")
    g = X.digit_groups(F.col("c"), F.col("is_time"))
    o = o.withColumn("g", g)
    return o.select("o_orderkey", X.format_mark(F.col("c"), F.col("is_time")).alias("text"), (F.coalesce(F.col("g.high"), F.lit(0)) * 60 + F.col("g.mid")).alias("whole"), F.col("g.low").alias("low"), X.from_digit_groups(F.col("g")).alias("back"))


@query("""SELECT c_custkey, (c_custkey % 12)::INT AS place, (c_custkey % 12) BETWEEN 1 AND 3 AS podium, c_custkey AS id, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey END AS positive,
  CASE WHEN c_mktsegment = 'BUILDING' THEN -c_acctbal ELSE c_acctbal END AS key, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'min10' ELSE 'max9' END AS size_rule,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'Throws' WHEN 'MACHINERY' THEN 'Jumps' WHEN 'HOUSEHOLD' THEN 'Jumps' ELSE 'Track' END AS family FROM customer""")
def p4_to_p16_columns(spark, sf):
    """P4, P5, P6, P12, P14, P16."""
    c = t(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "BUILDING", "time").when(seg == "MACHINERY", "height").otherwise("points")
    place = X.parse_place(F.when(F.col("c_custkey") % 12 == 0, "DNF").otherwise(F.concat((F.col("c_custkey") % 12).cast("string"), F.lit("."))))
    rule = X.final_size_rule(F.when(seg == "BUILDING", "distance").otherwise(kind))
    return c.select("c_custkey", place.alias("place"), X.on_podium(place).alias("podium"), X.trailing_id(F.concat(F.lit("some-name-"), F.col("c_custkey").cast("string"))).alias("id"), X.positive_int(F.col("c_nationkey").cast("string")).alias("positive"), X.sort_key(F.col("c_acctbal"), seg != "BUILDING").alias("key"), rule.alias("size_rule"), X.family(seg, ["MACHINERY", "HOUSEHOLD"], ["FURNITURE"]).alias("family"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN false WHEN 'click' THEN user_id % 2 = 0 WHEN 'error' THEN false ELSE true END AS wanted FROM events")
def p13_preferences(spark, sf):
    e = t(spark, sf, "events")
    prefs = F.create_map(F.lit("click"), F.col("user_id") % 2 == 0)
    return e.select("event_id", X.preference(prefs, {"view": False, "click": True, "purchase": True, "signup": True}, F.col("event_type")).alias("wanted"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'wid')")
def p7_name_match(spark, sf):
    return t(spark, sf, "part").where(X.name_matches(F.col("p_name"), F.lit("RÉD wid"))).select("p_partkey")


_ASKED = "SELECT DISTINCT substr(split_part(p_name, ' ', 2), 2, 3) || ' ' || upper(substr(p_name, 1, 2)) AS query FROM part"


@query(f"""WITH h AS (SELECT DISTINCT query, p_partkey FROM ({_ASKED}) JOIN part ON contains(lower(p_name), lower(split_part(query, ' ', 1))) AND contains(lower(p_name), lower(split_part(query, ' ', 2))))
SELECT query, p_partkey, row_number() OVER (PARTITION BY query ORDER BY p_partkey) AS hit FROM h QUALIFY hit <= 12""")
def t2_name_search(spark, sf):
    """Letters from within the second word and, in capitals, the first two of the first, asked of all names."""
    p = t(spark, sf, "part").select("p_partkey", "p_name")
    asked = F.concat(F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 2, 3), F.lit(" "), F.upper(F.substring("p_name", 1, 2)))
    hits = L.name_hits(p, p.select(asked.alias("query")).distinct(), "p_name", "query", [F.col("p_partkey")])
    return hits.select("query", "p_partkey", F.col("hit").cast("bigint").alias("hit"))


_EVENT = "SELECT min(p_partkey) AS event_id, p_size % 2 AS gender, p_name AS name FROM part GROUP BY ALL"
_OF_GROUP = "SELECT DISTINCT p_brand AS slug, p_size % 2 AS gender, upper(unnest([p_name, split_part(p_name, ' ', 2), 'x ' || p_type])) AS d FROM part WHERE p_partkey % 5 = 0"


@query(f"""WITH e AS ({_EVENT}), g AS ({_OF_GROUP}),
  hit AS (SELECT slug, g.gender, e.event_id, row_number() OVER (PARTITION BY slug, g.gender ORDER BY len(d) DESC, d, e.event_id) AS n FROM g JOIN e ON g.gender = e.gender AND (lower(e.name) = lower(d) OR ends_with(lower(e.name), ' ' || lower(d))))
SELECT slug, gender, hit.event_id FROM (SELECT DISTINCT slug, gender FROM g) LEFT JOIN (SELECT * FROM hit WHERE n = 1) hit USING (slug, gender)""")
def j6_event_resolution(spark, sf):
    """Brands as groups with discipline names in capitals, part names as events: whole names or their last words."""
    part = t(spark, sf, "part").withColumn("gender", F.col("p_size") % 2)
    events = part.groupBy("gender", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("event_id")).withColumn("pos", F.col("event_id"))
    names = F.explode(F.array(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.concat(F.lit("x "), F.col("p_type"))))
    groups = part.where("p_partkey % 5 = 0").select(F.col("p_brand").alias("slug"), "gender", names.alias("d")).groupBy("slug", "gender").agg(F.array_sort(F.collect_set(F.upper("d"))).alias("disciplines"))
    return L.events_of_groups(groups, events)


@query("""WITH h AS (SELECT c_mktsegment AS query, c_custkey, CASE WHEN c_acctbal > 9000 THEN 'ranked' ELSE 'listed' END AS origin FROM customer WHERE c_acctbal > 9000 OR c_nationkey = 7)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY origin = 'listed', c_custkey) AS hit FROM h QUALIFY hit <= 12""")
def j7_search_union(spark, sf):
    """Twelve hits of each query: ranked ones first, then those that are only listed."""
    c = t(spark, sf, "customer").withColumn("query", F.col("c_mktsegment"))
    out = L.with_unranked(c.where("c_acctbal > 9000").select("query", "c_custkey"), c.where("c_nationkey = 7").select("query", "c_custkey"), "c_custkey", ["query"], [F.col("c_custkey")], 12)
    return out.withColumn("hit", F.col("hit").cast("bigint"))


@query("""SELECT c.c_custkey AS athlete, c.c_nationkey AS calculation_id, n.n AS suppliers, q.q AS late FROM customer c LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) n ON n.s_nationkey = c.c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS q FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) q ON q.o_custkey = c.c_custkey""")
def j8_standings_joined(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("athlete"), F.col("c_nationkey").alias("calculation_id"))
    n = t(spark, sf, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("calculation_id")).agg(F.count("*").alias("suppliers"))
    q = t(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("athlete")).agg(F.count("*").alias("late"))
    return L.standings_joined(c, n, q).select("athlete", "calculation_id", "suppliers", "late")


@query("""WITH g AS (SELECT r_name AS gender, n_name AS slug, row_number() OVER (PARTITION BY r_name ORDER BY -n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
SELECT a.gender, a.slug, coalesce(s.slug, b.slug) AS counterpart FROM g a LEFT JOIN g s ON s.slug = a.slug AND s.gender <> a.gender LEFT JOIN g b ON b.n = a.n AND b.gender <> a.gender""")
def j10_counterparts(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region").where("r_name in ('ASIA', 'EUROPE')")
    return L.counterparts(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("gender"), F.col("n_name").alias("slug"), (-F.col("n_nationkey")).alias("pos")))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment WHEN c_acctbal > 0 THEN 'carried' ELSE 'default' END AS "group" FROM customer""")
def j12_default_resolution(spark, sf):
    c = t(spark, sf, "customer").withColumn("carried", F.when(F.col("c_acctbal") > 0, "carried"))
    g = t(spark, sf, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_mktsegment").alias("slug"))
    return L.resolved(c, g, "c_mktsegment", "default").select("c_custkey", "group")


_DIGITS = f"SELECT DISTINCT mark_c // 1000 AS a, mark_c // 100 % 10 AS b, mark_c // 10 % 10 AS c, mark_c % 10 AS d FROM ({LADDER})"


@query(f"""WITH m AS ({_DIGITS}), l AS (SELECT 0 AS level, '' AS prefix, a AS v FROM m UNION SELECT 1, a::VARCHAR, b FROM m UNION SELECT 2, a || '/' || b, c FROM m UNION SELECT 3, a || '/' || b || '/' || c, d FROM m)
SELECT level, prefix, string_agg(v::VARCHAR, ',' ORDER BY v) AS choices FROM l WHERE level IN (SELECT level FROM l GROUP BY level HAVING count(DISTINCT v) > 1) GROUP BY level, prefix""")
def a13_facets(spark, sf):
    m = ladder(spark, sf)
    d = m.select(F.floor(F.col("mark_c") / 1000).alias("a"), (F.floor(F.col("mark_c") / 100) % 10).alias("b"), (F.floor(F.col("mark_c") / 10) % 10).alias("c"), (F.col("mark_c") % 10).alias("d"))
    return L.facets(d, ["a", "b", "c", "d"])


@query("""WITH top AS (SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 25)
SELECT grp, string_agg(DISTINCT v, ',' ORDER BY v) AS found FROM (SELECT c_mktsegment AS grp, o_orderpriority || '/' || o_orderstatus AS v FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (SELECT c_custkey FROM top)
UNION ALL SELECT c_mktsegment, c_mktsegment FROM customer) GROUP BY 1""")
def a8_harvest(spark, sf):
    """Values of the 25 best customers of each segment, and the segment's own."""
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer").withColumnRenamed("c_mktsegment", "grp")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select("grp", "c_custkey", F.concat_ws("/", F.concat(F.lit(" "), F.col("o_orderpriority")), "o_orderstatus").alias("v"))
    best = L.top_ranked(c, ["grp"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 25).select("c_custkey")
    return L.harvested(c.select("grp", F.col("grp").alias("v")), rows, ["grp"], "v", best).select("grp", F.array_join("found", ",").alias("found"))


@query(f"SELECT slug, count(*) AS n, min(mark_c) AS lowest, max(points) AS top FROM ({LADDER}) GROUP BY slug")
def a12_table_statistics(spark, sf):
    return K.table_statistics(ladder(spark, sf), ["slug"], "mark_c", "points")


@query(f"SELECT slug, mark_c, row_number() OVER (PARTITION BY slug ORDER BY CASE slug WHEN 'even' THEN -mark_c ELSE mark_c END) AS best FROM ({LADDER})")
def t1_direction_sort(spark, sf):
    return D.best_first(ladder(spark, sf), ["slug"], X.sort_key(F.col("mark_c"), F.col("slug") == "even")).select("slug", "mark_c", "best")


@query("""SELECT c_mktsegment AS slug, 'x' AS gender, max(c_name) OVER (PARTITION BY c_mktsegment, 1) AS rank_date, c_custkey, c_acctbal FROM customer""")
def s4_ranking_pages(spark, sf):
    """Pages of 50 rows, each with a date of which the first page's counts."""
    c = t(spark, sf, "customer")
    paged = R.page_of(c, [F.col("c_custkey")], 50, ["c_mktsegment"])
    pages = paged.groupBy(F.col("c_mktsegment").alias("slug"), "page").agg(F.collect_list(F.struct("c_custkey", "c_acctbal")).alias("rankings"))
    date = c.groupBy(F.col("c_mktsegment").alias("slug")).agg(F.max("c_name").alias("rank_date"))
    pages = pages.join(date, "slug").withColumn("gender", F.lit("x")).withColumn("rank_date", F.when(F.col("page") == 1, F.col("rank_date")))
    return R.ranking_pages(pages)


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, o_orderkey, o_totalprice FROM orders")
def s6_counting_rows(spark, sf):
    nested = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("results"))
    return R.counting_rows(nested, ["o_custkey"]).withColumn("ord", F.col("ord").cast("bigint"))


@query("""SELECT event, pos, slug FROM (SELECT n_regionkey AS event, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS pos, CASE WHEN s_acctbal > 0 THEN s_name END AS slug FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE slug IS NOT NULL""")
def s7_qualification_rows(spark, sf):
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("event"), F.struct("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("slug")).alias("q"))
    systems = rows.groupBy("event").agg(F.array_sort(F.collect_list("q")).alias("qualifications"))
    return R.qualification_rows(systems, ["event"]).select("event", F.col("pos").cast("bigint").alias("pos"), "slug")


@query("SELECT o_custkey, o_orderpriority AS discipline, o_orderdate::DATE AS date, o_totalprice AS mark FROM orders WHERE o_orderstatus <> 'P'")
def s8_profile_results(spark, sf):
    o = t(spark, sf, "orders").withColumn("r", F.struct(F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("mark")))
    d = o.groupBy("o_custkey", "o_orderpriority").agg(F.collect_list("r").alias("results"))
    p = d.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), "results")).alias("disciplines"))
    return R.profile_results(p, ["o_custkey"])


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) IN (1999, 2000) AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def s5_s9_results_of_years(spark, sf):
    """Results rewritten by year, then read for two years; partitions prune."""
    from ..sources.writers import rewrite

    path = shared_folder(spark, "results")
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("discipline"), F.year("o_orderdate").alias("year"))
    rewrite(o, path, ["year"])
    return R.results_of_years(spark, path, [1999, 2000], ["1-URGENT", "5-LOW"]).select("o_orderkey", "year")


@query(f"SELECT mark_c, points FROM ({LADDER}) WHERE slug = 'even'")
def s12_projection(spark, sf):
    from ..sources.writers import project_one

    path = shared_folder(spark, "one")
    project_one(ladder(spark, sf), path, "slug = 'even'", ["mark_c", "points"])
    return spark.read.parquet(path)


_SPEC = "CASE o_orderstatus WHEN 'F' THEN 'time' WHEN 'O' THEN 'distance' ELSE 'points' END"


@query(f"""WITH h AS (SELECT o_orderkey, {_SPEC} AS kind, (o_orderkey % 4)::INT AS d, round(o_totalprice * 100)::BIGINT % 1000000 AS c FROM orders), u AS (SELECT *, (c * (10 ** d)::BIGINT + 50) // 100 AS units, (10 ** d)::BIGINT AS scale FROM h),
  w AS (SELECT *, units // scale AS whole, CASE WHEN d > 0 THEN '.' || lpad((units % scale)::VARCHAR, d, '0') ELSE '' END AS rest FROM u)
SELECT o_orderkey, CASE WHEN kind <> 'time' OR whole < 60 THEN whole || rest WHEN whole < 3600 THEN printf('%d:%02d', whole // 60, whole % 60) || rest ELSE printf('%d:%02d:%02d', whole // 3600, whole // 60 % 60, whole % 60) || rest END
  || CASE kind WHEN 'time' THEN '' WHEN 'distance' THEN ' m' ELSE ' p' END AS text FROM w""")
def p3_marks_by_spec(spark, sf):
    """Times, distances and points with no to three decimals, and their unit."""
    o = t(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "time").when(F.col("o_orderstatus") == "O", "distance").otherwise("points")
    unit = F.when(kind == "time", "s").when(kind == "distance", "m").otherwise("p")
    spec = F.struct(kind.alias("kind"), (F.col("o_orderkey") % 4).cast("int").alias("decimals"), unit.alias("unit"))
    o = o.select("o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("bigint") % 1_000_000).alias("c"), spec.alias("spec"))
    return o.select("o_orderkey", X.mark_text(F.col("c"), F.col("spec")).alias("text"))


_NTH = "ascii(right(p_brand, 1)) % 3"


@query(f"""SELECT lower(replace(p_brand, '#', '-')) || CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN '10000m' ELSE '' END AS label, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN '10000m' ELSE lower(replace(p_brand, '#', '-')) END AS slug,
  CASE WHEN {_NTH} = 1 THEN 'men' ELSE 'women' END AS gender, ['High Jump', 'Javelin Throw', '100m'][({_NTH})::INT + 1] AS main_event, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS disciplines, ['height', 'distance', 'time'][({_NTH})::INT + 1] AS kind, {_NTH} < 2 AS higher, 2 AS decimals,
  CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 18 ELSE 12 END AS window_months, 5 AS counting_results FROM part GROUP BY p_brand""")
def s1_event_groups(spark, sf):
    """Brands as event groups, landed as one JSON document of nested rows and read back with what the code adds."""
    part = t(spark, sf, "part")
    first = part.agg(F.min("p_brand").alias("first"))
    plain = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    nth = F.ascii(F.right("p_brand", F.lit(1))) % 3
    g = part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("disciplines")).withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one")
    own = F.col("p_brand") == F.col("first")
    g = g.select(
        F.concat(plain, F.when(own, "10000m").otherwise("")).alias("label"), F.when(nth == 1, "men").otherwise("women").alias("gender"), F.element_at(F.array(*map(F.lit, ("High Jump", "Javelin Throw", "100m"))), nth + 1).alias("mainEvent"),
        F.array(plain).alias("similarEvents"), F.when(own, "10000m").otherwise(plain).alias("slug"), "disciplines",
    )
    path = shared_folder(spark, "groups")
    g.agg(F.collect_list(F.struct(*g.columns)).alias("groups")).write.json(path)  # a rule table: one document
    out = R.event_groups(spark, path)
    return out.select("label", "slug", "gender", "main_event", F.array_join("disciplines", ";").alias("disciplines"), "mark.kind", F.col("mark.better_is_higher").alias("higher"), "mark.decimals", "window_months", "counting_results")


@query(f"""SELECT slug, CASE slug WHEN 'even' THEN 'men' ELSE 'women' END AS gender, mark_c, points::INT AS points, higher, row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN higher THEN -mark_c ELSE mark_c END) AS best FROM ({LADDER})""")
def s2_ladder_chunks(spark, sf):
    """Heights and times as text, landed as one document of nested marks in each group's folder, with a mark that does not parse; read back best first."""
    path = shared_folder(spark, "ladders")
    rows = ladder(spark, sf).select("slug", F.when(F.col("higher"), "men").otherwise("women").alias("gender"), F.lit("x").alias("column"), X.format_mark(F.col("mark_c"), ~F.col("higher")).alias("mark"), F.col("points").cast("int").alias("points"))
    none = rows.select("slug", "gender", "column").distinct().withColumns({"mark": F.lit("-"), "points": F.lit(9)})
    W.ladder_chunks(rows.unionByName(none), path)
    specs = rows.select("slug", "gender", R.mark_spec(F.when(F.col("slug") == "even", "High Jump").otherwise("100m")).alias("mark")).distinct()
    return R.ladders(spark, path, X.parse_mark, specs).select("slug", "gender", "mark_c", "points", "higher", F.col("best").cast("bigint").alias("best"))


@query(f"SELECT table_no, category, place_key, points::INT AS points FROM ({PLACING})")
def s3_placing_tables(spark, sf):
    """S3: placing tables landed as one document of maps in maps in maps, and read back as rows."""
    path = shared_folder(spark, "placing")
    p = placing(spark, sf)
    mapped = lambda df, key, value, by, name: df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
    by_place = mapped(p, "place_key", "points", ["table_no", "category"], "by_place")
    scores = by_place.groupBy("table_no").agg(F.map_from_entries(F.collect_list(F.struct("category", "by_place"))).alias("scores"))
    tables = scores.agg(F.map_from_entries(F.collect_list(F.struct("table_no", F.struct(F.col("table_no").alias("title"), "scores").alias("t")))).alias("tables"))
    tables.write.json(path)  # a rule table: one document
    return R.placing_tables(spark, path)


@query("""WITH g AS (SELECT DISTINCT c_mktsegment AS grp FROM customer), named AS (SELECT grp FROM g WHERE grp <> (SELECT min(grp) FROM g))
SELECT grp, 'final' AS round_kind, 'group' AS selector_kind, NULL AS selector, CASE WHEN grp IN (FROM named) THEN grp ELSE '2.2' END AS table_no FROM g
UNION ALL SELECT grp, 'before_final', CASE s WHEN 'OW' THEN 'category' ELSE 'size' END, s, grp || s FROM named, (SELECT unnest(['OW', 'max9']) AS s)
UNION ALL SELECT grp, 'before_final', 'size', 'min10', '2.4' FROM g WHERE grp NOT IN (FROM named) UNION ALL SELECT grp, 'final', 'discipline', 'Road', grp || ' road' FROM named""")
def s3_placing_routes(spark, sf):
    """S3: the routing of market segments to tables, landed as one document; the first segment is not named and takes the default's."""
    path = shared_folder(spark, "routes")
    grp = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("grp")).distinct()
    shape = lambda final, before, own: F.struct(final.alias("final"), before.alias("beforeFinal"), own.alias("byDiscipline"))
    road = F.create_map(F.lit("Road"), F.struct(F.concat("grp", F.lit(" road")).alias("final")))
    own = shape(F.col("grp"), F.map_from_arrays(F.array(*map(F.lit, ("OW", "max9"))), F.array(F.concat("grp", F.lit("OW")), F.concat("grp", F.lit("max9")))), road)
    default = shape(F.lit("2.2"), F.create_map(F.lit("min10"), F.lit("2.4")), F.lit(None).cast("map<string,struct<final:string>>"))
    first = grp.agg(F.min("grp").alias("grp"))
    rows = grp.join(F.broadcast(first), "grp", "left_anti").select("grp", own.alias("t")).unionByName(first.select(F.lit("default").alias("grp"), default.alias("t")))
    rows.agg(F.map_from_entries(F.collect_list(F.struct("grp", "t"))).alias("eventGroupTables")).write.json(path)
    return R.placing_routes(spark, path, grp.withColumnRenamed("grp", "slug"))


@query("SELECT 'even' AS slug, 'men' AS gender, 'disagrees' AS problem UNION ALL SELECT 'new', 'men', 'missing' UNION ALL SELECT 'odd', 'women', 'stale'")
def u3_chunk_differences(spark, sf):
    """Chunks by folder against the combined ladders: one disagrees in one mark, one was never written, one is left over."""
    path = shared_folder(spark, "chunks")
    rows = ladder(spark, sf).select("slug", F.when(F.col("higher"), "men").otherwise("women").alias("gender"), F.lit("x").alias("column"), "mark_c", F.col("points").cast("int").alias("points"))
    W.ladder_chunks(rows.withColumn("mark", X.format_mark(F.col("mark_c"), F.lit(False))), path)
    listed = rows.where("slug = 'even'").drop("column")
    combined = listed.withColumn("points", F.col("points") + (F.col("points") == 1).cast("int")).unionByName(listed.withColumn("slug", F.lit("new")))
    return W.chunk_differences(combined, R.ladders(spark, path, X.parse_mark))
