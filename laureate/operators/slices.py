"""Cutting an ordered group of any size into slices that are worked on apart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    """Equality of the left's columns with the right's, which carry a prefix; nulls are equal."""
    return reduce(and_, [left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in names])


def renamed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in names})


def sliced(rows: DataFrame, group: Sequence[str], key: str, slices: int = 256) -> DataFrame:
    """Adds _slice: 0 for a group's least keys, then 1 and so on; keys in order have slices in order. Null keys, which may be there, have slice -1.

    Keys do not repeat within a group. It is cut at a sample of them, the `slices` - 1 of least hash, so slices hold about equally many keys however those
    lie. The cuts depend on the keys alone: branches of a plan that cut apart, and tasks that run again, cut alike. At most slices - 1 keys of a group leave a task for it.
    """
    least = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(key), key))
    sample = rows.select(*group, key).where(F.col(key).isNotNull()).withColumn("_nth", least).where(F.col("_nth") < slices)
    edges = renamed(sample.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("_edges")), group, "_e_")
    place = F.when(F.col(key).isNull(), -1).otherwise(F.coalesce(F.size(F.filter("_edges", lambda x: x < F.col(key))), F.lit(0)))
    return rows.join(edges, same(rows, edges, group, "_e_"), "left").withColumn("_slice", place).drop(*edges.columns)
