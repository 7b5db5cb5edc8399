"""Exact top-k search: tiled products of query blocks and shards, merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component, as double. Vectors that are
    null or hold null or non-finite components are left out, as are rows without vec_id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), x.alias("_x")).where(fine)
    return rows.select("vec_id", F.transform("_x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row: highest score, ties to the smaller id. Rows of `score`
    where nothing counts hold the least integer."""
    if score.shape[1] <= k:
        part = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    else:
        # All that reach the k-th score, so that ties at the border are settled by id.
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        reach = score >= edge
        width = int(reach.sum(axis=1).max())
        part = np.argsort(~reach, axis=1, kind="stable")[:, :width]
    s, i = np.take_along_axis(score, part, 1), ids[part]
    return np.take_along_axis(part, np.lexsort((i, -s), axis=1)[:, :k], 1)


def _dims(batch: pa.RecordBatch) -> np.ndarray:
    return np.diff(batch.column(3).offsets.to_numpy())


def _matrix(batch: pa.RecordBatch, dims: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows of that length."""
    same = sizes == dims
    flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
    return batch.column(2).to_numpy(zero_copy_only=False)[same], flat[np.repeat(same, sizes)].reshape(-1, dims).astype(np.float64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products: by floating point where every partial sum stays below 2^53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


class _Asked:
    """Queries of one length, with the best rows seen so far; where fewer than k count, the score is the least."""

    LOW = np.iinfo(np.int64).min // 2

    def __init__(self, ids: np.ndarray, q: np.ndarray):
        self.ids, self.q = ids, q
        self.score, self.found = np.full((len(ids), 0), self.LOW), np.zeros((len(ids), 0), np.int64)

    def meet(self, ids: np.ndarray, v: np.ndarray, k: int, block: int) -> None:
        """Multiplies all queries, `block` at a time, with a tile of rows and keeps the k best of each."""
        kept = []
        for at in range(0, len(self.ids), block):
            part = slice(at, at + block)
            s = _exact(self.q[part], v)
            s[self.ids[part, None] == ids[None, :]] = self.LOW
            cols = _best(s, ids, k)
            s, i = np.concatenate([self.score[part], np.take_along_axis(s, cols, 1)], 1), np.concatenate([self.found[part], ids[cols]], 1)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            kept.append((np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)))
        self.score, self.found = (np.concatenate(x) for x in zip(*kept, strict=True))


class _Cell:
    """A part of the queries, held, and a part of the rows, which stream by and are held a tile at a time."""

    def __init__(self, cell: int, k: int, block: int, tile: int):
        self.cell, self.k, self.block, self.tile = cell, k, block, tile
        self.asked: dict[int, _Asked] = {}
        self.waiting: dict[tuple[int, int], list] = {}

    def add(self, part: pa.RecordBatch, is_row: int) -> None:
        for d in np.unique(dims := _dims(part)):
            if is_row and (0, d) in self.waiting:
                self._close(d)
            if is_row and d not in self.asked:
                continue
            held = self.waiting.setdefault((is_row, d), [])
            held.append(_matrix(part, d, dims))
            if is_row and sum(len(ids) for ids, _ in held) >= self.tile:
                self._multiply(d)

    def _close(self, d: int) -> None:
        self.asked[d] = _Asked(*(np.concatenate(x) for x in zip(*self.waiting.pop((0, d)), strict=True)))

    def _multiply(self, d: int) -> None:
        ids, v = (np.concatenate(x) for x in zip(*self.waiting.pop((1, d)), strict=True))
        for at in range(0, len(ids), self.tile):
            self.asked[d].meet(ids[at : at + self.tile], v[at : at + self.tile], self.k, self.block)

    def lists(self) -> Iterator[pa.RecordBatch]:
        for is_row, d in list(self.waiting):
            if is_row:
                self._multiply(d)
        for a in self.asked.values():
            for at in range(0, len(a.ids), self.block):
                score = a.score[at : at + self.block]
                row, col = np.nonzero(score > _Asked.LOW)
                found = a.found[at : at + self.block]
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.full(len(row), self.cell, np.int64)), "query_id": pa.array(a.ids[at + row]), "vec_id": pa.array(found[row, col]), "score": pa.array(score[row, col])})


def _search(k: int, block: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, is_row, vec_id, v) come sorted by cell, in each its queries first, then the rows that they are compared with."""
        at = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            for s, e in zip([0, *edges], [*edges, len(key)], strict=True):
                if s == e:
                    continue
                if at is None or key[s] // 2 != at.cell:
                    if at is not None:
                        yield from at.lists()
                    at = _Cell(int(key[s] // 2), k, block, tile)
                at.add(batch.slice(s, e - s), int(key[s] % 2))
        if at is not None:
            yield from at.lists()

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, block: int = 1024, tile: int = 4096, shard: int = 1 << 20, held: int = 1 << 22, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query among all
    other rows; ties go to the smaller vec_id.

    Rows are dealt out to shards of about `shard`, the queries, a stated set, to parts of about `held` components, and a task
    takes one part and one shard: nothing passes the driver. It holds its queries and their lists while the shard's rows stream by, multiplies
    them tile by tile and keeps k per query, so that a shard of any size costs the same memory. A row is sent once per part and a query once
    per shard. The lists are merged as a tree, `fan_in` at a time. Rows that repeat a vec_id count each; a row never meets its own id; of
    several vectors of a query's id the least, by components, asks. Vectors of other lengths are not compared. Rows without
    vec_id, and vectors that are null or hold null or non-finite components, take no part. Other columns are not read. Empty
    tables give no rows.
    """
    spark = vectors.sparkSession
    path = shared_dir(spark)
    rows = stored(integer_vectors(vectors.select("vec_id", "embedding")), f"{path}/rows")
    asked = stored(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), f"{path}/asked")
    n = rows.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("longest")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n["rows"] // shard))
    parts = max(1, -(-asked.count() * (n["longest"] or 1) // held))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    streamed = rows.select((F.monotonically_increasing_id() % shards).alias("g"), each(parts).alias("part"), F.lit(1).alias("is_row"), "vec_id", "v")
    sent = asked.select(each(shards).alias("g"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.lit(0).alias("is_row"), "vec_id", "v")
    both = streamed.unionByName(sent).select((F.col("g") * parts + F.col("part")).alias("cell"), "is_row", "vec_id", "v")
    both = both.repartition(shards * parts, "cell").sortWithinPartitions("cell", "is_row")
    found = both.mapInArrow(_search(k, block, tile), "cell bigint, query_id bigint, vec_id bigint, score bigint").withColumn("g", F.floor(F.col("cell") / parts))
    key = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))
    top = found.groupBy("query_id", F.floor(F.col("g") / fan_in).alias("g")).agg(F.slice(F.array_sort(F.collect_list(key)), 1, k).alias("top"))
    lists = -(-shards // fan_in)
    while lists > 1:
        top = top.groupBy("query_id", F.floor(F.col("g") / fan_in).alias("g")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        lists = -(-lists // fan_in)
    out = top.select("query_id", F.posexplode("top").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
