"""What the training-data operators share: shared storage, reading, task-side columns, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of characters other than ASCII space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the one that the cluster shares, which the session must name in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    return f"{base.rstrip('/')}/laureate-{uuid.uuid4().hex}"


_BLANK = re.compile(rb"[ \t-\r]")


def segments(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about `size` bytes, cut at white space, so that no word is cut: what is made of the words of a text of
    any length is made of one part at a time."""
    at = 0
    while at < len(data):
        found = _BLANK.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def stored(df: DataFrame, path: str) -> DataFrame:
    """Cuts the lineage at a written table: a lost executor costs a read, not the work before."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str, rows: int = 512, **kw) -> DataFrame:
    """Applies fn(**lists of each input column) -> dict of output columns to slices of at most
    `rows` rows, so that a task holds few texts at once. fn sees whole rows, in order."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(**{n: part.column(i).to_pylist() for i, n in enumerate(names)}, **kw)
                yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v): each node's neighbours move to the smallest of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(low, "u").where("v > u")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u bigint, v bigint) as (node, root), root the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is a
    map-side-combined minimum and an equi-join that AQE may split, so a hub of any degree
    never meets in one task. Each round is written to the shared folder. Self-loops and nulls are left out.
    """
    spark = edges.sparkSession
    at = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before, last = None, []
    for i in range(rounds):
        where = f"{path}/cc-{i}"
        at = stored(_star(_star(at, True), False), where)
        state = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(spark, *last)
        last = [where]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
