"""Digests with cadences of their own: results by day, rankings by list and period; broken input apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import preference
from ..operators.changes import composed_chain, digest
from .jobs import _written
from .standings import COMPARED

CORRUPT = "_corrupt_record"
OUTBOX = "fan bigint, digest string, period string, athlete bigint, kind string, item string, from_value bigint, to_value bigint, updated date, batch int"
LOG = "fan bigint, digest string, period string, status string, n_athletes bigint, n_items bigint, body string, batch int"
TOLD = "fan bigint, athlete bigint, batch int"
#: The preference that each kind of change falls under; all are on unless a fan has switched one off.
PREFERENCE = {"world": "place", "european": "place", "score": "score", "qualified": "qualification", "result": "result"}


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stream of sound JSON lines under `path`. Lines that are cut off or hold a value of another type are left out, and counted on the way: the
    stream observes rows and broken."""
    lines = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    seen = lines.observe("landed", F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("broken"))
    return seen.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def _events(batch: DataFrame, follows: DataFrame, introduced: DataFrame) -> DataFrame:
    """(fan, digest, athlete, kind, item, from_value, to_value): what a run has to tell each fan, by preferences."""
    none = F.lit(None).cast("bigint")
    moved = composed_chain(batch.where(F.col("kind").isin(*COMPARED)), ["athlete", "gender", "kind"], "day").select("athlete", "gender", "kind", F.lit(None).cast("string").alias("item"), "from_value", "to_value")
    news = batch.where("kind = 'result' and item is not null").select("athlete", "gender", "kind", "item", none.alias("from_value"), none.alias("to_value")).distinct()
    mine = follows.join(moved.unionByName(news), ["athlete", "gender"])
    of = F.element_at(F.create_map(*[F.lit(x) for kv in PREFERENCE.items() for x in kv]), F.col("kind"))
    mine = mine.where(preference(F.col("prefs"), dict.fromkeys(PREFERENCE.values(), True), of))
    standing = batch.where("kind = 'standing'").groupBy("athlete", "gender", "kind").agg(F.max_by("item", "day").alias("item")).withColumns({"from_value": none, "to_value": none})
    owed = follows.join(introduced, ["fan", "athlete"], "left_anti").join(standing, ["athlete", "gender"])
    digest_of = F.when(F.col("kind") == "result", "results").otherwise(F.concat(F.lit("ranking:"), "gender"))
    columns = ["fan", digest_of.alias("digest"), "athlete", "kind", "item", "from_value", "to_value"]
    return mine.select(*columns).unionByName(owed.select(*columns))


def _merged(pending: DataFrame, events: DataFrame) -> DataFrame:
    """Pending and new told as one: A to B and B to C is A to C, what returned to its start vanishes, a result is told once, and an introduction
    that is owed stays as it was. Adds the pending period, where there is one."""
    both = pending.withColumn("_side", F.lit(0)).unionByName(events.withColumns({"period": F.lit(None).cast("string"), "_side": F.lit(1)}))
    out = both.groupBy("fan", "digest", "athlete", "kind", F.when(F.col("kind") == "result", F.col("item")).alias("_item")).agg(
        F.min_by("item", "_side").alias("item"), F.min_by("from_value", "_side").alias("from_value"), F.max_by("to_value", "_side").alias("to_value"), F.max("period").alias("pending"),
    )
    return out.where(F.col("kind").isin("result", "standing") | ~F.col("from_value").eqNullSafe(F.col("to_value"))).drop("_item")


def cadence_run(folder: str, follows: DataFrame, sendable: Callable[[int], Column], opted_in: Callable[[int], Column] | None = None, keep_days: int = 7):
    """A foreachBatch function over changes (athlete, gender, day, kind, from_value, to_value, item): digests of one run.

    kind is one of standings.COMPARED with its two values, `result` with its item, or `standing` with the text that introduces an athlete whose ranking
    moved on. follows: (fan, athlete, gender, prefs), prefs a map over PREFERENCE. A fan gets a digest `results` for the run's day, its
    newest, and one `ranking:<gender>` for that list's newest day, each once per period. An athlete's changes are left out of a ranking digest that introduces them.
    Digests for which sendable(batch number) is false are parked with the run's day and join the next run's; entries parked over keep_days ago go.
    Fans for whom opted_in(batch number) is false get nothing, and their parked entries are left alone. outbox, log and
    introductions are written under the batch's number and read from earlier ones only, so a batch that runs again gives the same.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # read several times; a lost block is computed again from the source
        at = lambda name: f"{folder}/{name}/batch={number}"
        today = batch.agg(F.max("day")).first()[0]
        active = opted_in(number) if opted_in else F.lit(True)
        kept = _written(spark, f"{folder}/outbox", OUTBOX, number).where(F.col("batch") == number - 1).drop("batch")
        kept = kept.where(F.col("updated") >= F.date_sub(F.lit(today), keep_days)) if today else kept
        introduced = _written(spark, f"{folder}/introduced", TOLD, number).select("fan", "athlete").distinct()
        events = _events(batch, follows.where(active), introduced)
        _merged(kept.where(active).drop("updated"), events).write.mode("overwrite").parquet(at("merged"))
        merged = spark.read.parquet(at("merged"))
        weeks = batch.where("kind <> 'result'").groupBy(F.concat(F.lit("ranking:"), "gender").alias("digest")).agg(F.max("day").cast("string").alias("week"))
        period = F.when(F.col("digest") == "results", F.lit(today).cast("string")).otherwise(F.coalesce("week", "pending"))
        due = merged.join(F.broadcast(weeks), "digest", "left").groupBy("fan", "digest").agg(F.max(period).alias("period"))  # a row per list
        before = _written(spark, f"{folder}/log", LOG, number).where("status = 'sent'").select("fan", "digest", "period").distinct()
        due = due.where("period is not null").join(before, ["fan", "digest", "period"], "left_anti").withColumn("status", F.when(sendable(number), "sent").otherwise("error"))
        rows = merged.drop("pending").join(due, ["fan", "digest"])
        new = rows.groupBy("fan", "digest", "athlete").agg(F.bool_or(F.col("kind") == "standing").alias("_new"))
        shown = rows.join(new, ["fan", "digest", "athlete"]).where(~F.col("_new") | (F.col("kind") == "standing"))
        text = F.coalesce("item", F.concat("kind", F.lit(" "), F.col("from_value").cast("string"), F.lit(" > "), F.col("to_value").cast("string")))
        shown = shown.withColumns({"line": F.concat(F.col("athlete").cast("string"), F.lit(": "), text), "to": F.struct("fan", "digest", "period", "status")})
        told = digest(shown, "to", "athlete", "line", ["athlete", "kind"]).select("to.*", "n_athletes", "n_items", "body")
        parked = rows.where("status = 'error'").select("fan", "digest", "period", "athlete", "kind", "item", "from_value", "to_value", F.lit(today).cast("date").alias("updated"))
        parked.unionByName(kept.where(~active)).write.mode("overwrite").parquet(at("outbox"))
        rows.where("status = 'sent' and kind = 'standing'").select("fan", "athlete").write.mode("overwrite").parquet(at("introduced"))
        told.write.mode("overwrite").parquet(at("log"))
        batch.unpersist()

    return each
