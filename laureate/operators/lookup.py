"""Searches, resolutions and facets."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_FOLDED = {c: d[0] for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(0x300 <= ord(m) < 0x370 for m in d[1:])}


def folded(c: Column) -> Column:
    """Lower case, without accents, whether composed or not; Hangul syllables stay whole."""
    base = F.translate(c, "".join(_FOLDED), "".join(_FOLDED.values()))
    return F.trim(F.lower(F.regexp_replace(base, "[\u0300-\u036f]", "")))


#: Queries of a name search up to which they are sent to all tasks; more are joined by a shuffle.
FEW_QUERIES = 50_000


def name_hits(names: DataFrame, queries: DataFrame, name: str, query: str, order: Sequence[Column], limit: int = 12) -> DataFrame:
    """The first `limit` names of each query all of whose parts occur anywhere in the name, whatever case and accents.

    The first letters (three at most) of a query's longest part are joined to the runs of one to three letters of the names, and
    the candidates checked, so names and queries never form all pairs. Rows that repeat count once; a blank query has no hits.
    The runs are never broadcast: Spark takes a name's many for one row when it chooses a side. Queries are, after one count of at most FEW_QUERIES.
    """
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    n = names.distinct().withColumn("_name", folded(F.col(name)))
    n = n.withColumn("_t", F.explode(F.array_distinct(F.concat(*[runs(F.col("_name"), k) for k in (1, 2, 3)]))))
    q = queries.distinct().withColumn("_parts", F.filter(F.split(folded(F.col(query)), r"\s+"), lambda t: t != ""))
    longest = F.array_max(F.transform("_parts", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    q = q.withColumn("_t", F.substring(longest, 1, 3))
    q = F.broadcast(q) if queries.distinct().limit(FEW_QUERIES + 1).count() <= FEW_QUERIES else q.hint("merge")
    hit = n.join(q, "_t").where(F.forall("_parts", lambda t: F.contains(F.col("_name"), t)))
    w = Window.partitionBy(query).orderBy(*order)
    return hit.withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= limit).select(*queries.columns, *names.columns, "hit")


def events_of_groups(groups: DataFrame, events: DataFrame) -> DataFrame:
    """(slug, gender, event_id) of each group: the event of its gender whose name is one of its disciplines or ends with a blank and
    it, whatever case; the longest discipline with an event decides, then the first in its list, then the first event by
    `pos`. Null where the competition does not stage it. groups: slug, gender, disciplines; events: event_id, gender, name, pos.

    Every suffix of a name that follows a blank is a join key, so the join is on equality.
    """
    words = F.split(F.lower("name"), " ")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    e = events.select("gender", "event_id", "pos", F.explode(F.array_distinct(suffixes)).alias("_d"))
    d = groups.select("slug", "gender", F.posexplode("disciplines").alias("_i", "_name")).select("slug", "gender", "_i", F.length("_name").alias("_n"), F.lower("_name").alias("_d"))
    best = d.join(e, ["gender", "_d"]).groupBy("slug", "gender").agg(F.min_by("event_id", F.struct(-F.col("_n"), "_i", "pos")).alias("event_id"))
    return groups.select("slug", "gender").join(best, ["slug", "gender"], "left")


def with_unranked(ranked: DataFrame, others: DataFrame, key: str, query: Sequence[str] = (), order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Ranked hits, then those that only the other list has; with a limit, the first so many of each query."""
    both = ranked.withColumn("origin", F.lit("ranked")).unionByName(others.join(ranked.select(*query, key).distinct(), [*query, key], "left_anti").withColumn("origin", F.lit("listed")))
    if limit is None:
        return both
    w = Window.partitionBy(*query).orderBy(F.col("origin") == "listed", *order)
    return both.withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= limit)


def standings_joined(rankings: DataFrame, calculations: DataFrame, qualifications: DataFrame) -> DataFrame:
    """Left joins by calculation_id and athlete; an absent side stays null."""
    return rankings.join(calculations, "calculation_id", "left").join(qualifications, "athlete", "left")


def counterparts(groups: DataFrame, pos: str = "pos") -> DataFrame:
    """(gender, slug, counterpart): the other gender's group of the same slug, else of the same place in its list, which is
    ordered by `pos`. groups is a rule table: one row per group."""
    w = Window.partitionBy("gender").orderBy(pos)
    g = groups.select("gender", "slug", F.row_number().over(w).alias("n"))
    o = g.select(F.col("gender").alias("_og"), F.col("slug").alias("_os"), F.col("n").alias("_on"))
    same = g.join(o, (g["slug"] == o["_os"]) & (g["gender"] != o["_og"]), "left").select("gender", "slug", "n", F.col("_os").alias("_same"))
    nth = o.select(F.col("_og").alias("_g2"), F.col("_os").alias("_nth"), F.col("_on").alias("_n2"))
    out = same.join(nth, (same["n"] == nth["_n2"]) & (same["gender"] != nth["_g2"]), "left")
    return out.select("gender", "slug", F.coalesce("_same", "_nth").alias("counterpart"))


def fanned_out(favorites: DataFrame, state: DataFrame, snapshot: DataFrame, athlete: str) -> DataFrame:
    """State and snapshot of the distinct athletes that anyone follows, then to all followers."""
    distinct = favorites.select(athlete).distinct()
    shared = distinct.join(state, athlete, "left").join(snapshot, athlete, "left")
    return favorites.join(shared, athlete, "left")


def resolved(stored: DataFrame, groups: DataFrame, slug: str, default: str) -> DataFrame:
    """Adds group: the stored slug if it is a group, else the carried one, else the default."""
    known = groups.select(F.col("slug").alias("_k")).distinct()
    return stored.join(known, stored[slug] == known["_k"], "left").withColumn("group", F.coalesce("_k", "carried", F.lit(default))).drop("_k")


def facets(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(level, prefix, choices): of each position the distinct values given the ones before; a position with
    one value overall is hidden."""
    out = None
    shown = values.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    for i, c in enumerate(columns):
        if shown[c] <= 1:
            continue
        prefix = F.concat_ws("/", *[F.col(p).cast("string") for p in columns[:i]]) if i else F.lit("")
        level = values.groupBy(prefix.alias("prefix")).agg(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("bigint"))), ",").alias("choices"))
        level = level.select(F.lit(i).alias("level"), "prefix", "choices")
        out = level if out is None else out.unionByName(level)
    return out if out is not None else values.sparkSession.createDataFrame([], "level int, prefix string, choices string")


def top_ranked(ranked: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k of each key."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def harvested(listed: DataFrame, rows: DataFrame, key: Sequence[str], value: str, among: DataFrame | None = None) -> DataFrame:
    """Distinct trimmed values of two sources per key, sorted, without blanks; with `among`, only rows of its athletes
    (all its columns are join keys, as of top_ranked)."""
    rows = rows if among is None else rows.join(among, among.columns, "left_semi")
    both = listed.select(*key, F.trim(value).alias(value)).unionByName(rows.select(*key, F.trim(value).alias(value)))
    return both.where(F.col(value) != "").groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias("found"))
