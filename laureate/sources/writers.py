"""Sinks: partitioned rewrites, snapshots by version, outbox and delivery log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import upserted


def rewrite(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder per key; folders of keys that are gone go too (static overwrite)."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def ladder_chunks(rows: DataFrame, path: str) -> None:
    """Long ladders (slug, gender, column, mark as text, points) as documents of one map each, in a folder for each slug and gender; folders of
    ladders that are gone go too. A ladder is one document, as it is read whole."""
    one = rows.groupBy("slug", "gender").agg(F.max("column").alias("column"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("mark", "points")))).alias("marks"))
    one.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slug", "gender").json(path)


def chunk_differences(combined: DataFrame, chunks: DataFrame) -> DataFrame:
    """(slug, gender, problem) of chunks that are missing, stale or disagree with the combined ladders; both sides (slug, gender, mark_c, points)."""
    whole = lambda df, name: df.groupBy("slug", "gender").agg(F.array_sort(F.collect_list(F.struct("mark_c", "points"))).alias(name))
    both = whole(combined, "_all").join(whole(chunks, "_own"), ["slug", "gender"], "full_outer")
    problem = F.when(F.col("_own").isNull(), "missing").when(F.col("_all").isNull(), "stale").when(F.col("_all") != F.col("_own"), "disagrees")
    return both.select("slug", "gender", problem.alias("problem")).where("problem is not null")


def project_one(combined: DataFrame, path: str, where: str, columns: Sequence[str]) -> DataFrame:
    """One table out of a combined set."""
    out = combined.where(where).select(*columns)
    out.write.mode("overwrite").parquet(path)
    return out


class SnapshotStore:
    """State by version: each upsert writes a new one; the last is read. A write that fails leaves the last as it is."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], kept_if_null: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.key, self.kept = spark, path, schema, list(key), list(kept_if_null)
        self.version = max(self._versions(), default=0)  # a driver that starts anew goes on where the last one ended

    def _versions(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def read(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}")

    def upsert(self, new: DataFrame) -> DataFrame:
        merged = upserted(self.read(), new, self.key, self.kept)
        merged.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1
        return self.read()


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("sent_at", F.current_timestamp()).write.mode("append").parquet(path)


def outbox_after(outbox: DataFrame, saved: DataFrame, cleared: DataFrame, key: Sequence[str]) -> DataFrame:
    """Saved entries replace those of their key; cleared keys go."""
    kept = outbox.join(saved.select(*key), list(key), "left_anti").unionByName(saved)
    return kept.join(cleared.select(*key), list(key), "left_anti")
