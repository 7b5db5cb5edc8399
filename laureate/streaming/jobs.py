"""Streaming forms: roll-ups by event time, deliveries and digests by batch. Keyed state is in standings.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.changes import composed, composed_chain, digest, unsent

def rolled_up(stream: DataFrame, ts: str, length: str, late: str, by: list[str], value: str) -> DataFrame:
    """Tumbling windows by event time, for append mode: a window comes out once, when the watermark has passed its end; rows that
    come for it later are dropped."""
    t = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", length).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sent_once(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark: for keys that repeat within `late` only, as state older than that goes.
    Keys that must never be sent twice go through deliver_unsent and its log."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def _written(spark: SparkSession, path: str, schema, before: int) -> DataFrame:
    """Rows of the batches under `path` before a number: what a batch that runs again saw the first time."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") < before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def deliver_unsent(log: str, keys: list[str], send: Callable[[DataFrame], DataFrame]):
    """A foreachBatch function: hands keys that the log does not hold as sent to `send`, which returns them with a status, and logs
    those rows under the batch's number. A failed one is tried again when its key comes again; a batch that runs again
    replaces its own rows."""

    def each(batch: DataFrame, number: int) -> None:
        fields = [f for f in batch.schema if f.name in keys]
        schema = StructType([*fields, StructField("status", StringType()), StructField("batch", IntegerType())])
        fresh = unsent(batch.select(*keys).distinct(), _written(batch.sparkSession, log, schema, number), keys)
        send(fresh).select(*keys, "status").write.mode("overwrite").parquet(f"{log}/batch={number}")

    return each


OUTBOX = "fan bigint, athlete bigint, from_value bigint, to_value bigint, batch int"
RUN = "fan bigint, status string, n_athletes bigint, n_items bigint, body string, batch int"
COUNTERS = "resolved bigint, skipped bigint, sent bigint, failed bigint, batch int"


def digest_run(folder: str, fans: DataFrame, sendable: Callable[[int], Column]):
    """A foreachBatch function over changes (athlete, period, from_value, to_value, resolved): one digest per fan and batch.

    Changes of athletes that could not be resolved are left out and counted. The rest are composed within the batch, fanned out to
    those who follow (fan, athlete), and composed with what is pending for them; a change that returned to its start
    vanishes. Fans for whom sendable(batch number) is false stay pending. Outbox, log and counters are written under the batch's number and
    read from earlier ones only, so a batch that runs again gives the same and each change is told once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # read twice; a lost block is computed again from the source
        own = composed_chain(batch.where("resolved"), ["athlete"], "period").select("athlete", "from_value", "to_value")
        pending = _written(spark, f"{folder}/outbox", OUTBOX, number).where(F.col("batch") == number - 1).drop("batch")
        merged = composed(pending, fans.join(own, "athlete").select("fan", "athlete", "from_value", "to_value"), ["fan", "athlete"]).withColumn("ok", sendable(number))
        merged.write.mode("overwrite").parquet(f"{folder}/merged/batch={number}")
        merged = spark.read.schema(merged.schema).parquet(f"{folder}/merged/batch={number}")
        merged.where("not ok").drop("ok").write.mode("overwrite").parquet(f"{folder}/outbox/batch={number}")
        line = F.concat(F.col("athlete").cast("string"), F.lit(": "), F.col("from_value").cast("string"), F.lit(" > "), F.col("to_value").cast("string"))
        told = digest(merged.withColumn("line", line), "fan", "athlete", "line", ["athlete"]).withColumn("status", F.when(sendable(number), "sent").otherwise("failed"))
        told.select("fan", "status", "n_athletes", "n_items", "body").write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        log = spark.read.parquet(f"{folder}/log/batch={number}")
        counts = batch.agg(F.count_distinct(F.when(F.col("resolved"), F.col("athlete"))).alias("resolved"), F.count_distinct(F.when(~F.col("resolved"), F.col("athlete"))).alias("skipped"))
        states = log.agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"))
        both = counts.select("*", F.lit(0).cast("bigint").alias("sent"), F.lit(0).cast("bigint").alias("failed")).unionByName(states.select(F.lit(0).cast("bigint").alias("resolved"), F.lit(0).cast("bigint").alias("skipped"), "sent", "failed"))
        both.agg(*[F.sum(c).alias(c) for c in ("resolved", "skipped", "sent", "failed")]).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")
        batch.unpersist()

    return each


def each_batch(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a foreachBatch function over all that is there now."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(df: DataFrame, path: str, mode: str = "append", counted: dict[str, int] | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet, and reads it. What the stream observes on its way is added up in `counted`."""
    run = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    for progress in run.recentProgress if counted is not None else ():
        for metrics in progress.observedMetrics.values():
            for name, value in metrics.asDict().items():
                counted[name] = counted.get(name, 0) + (value or 0)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")
