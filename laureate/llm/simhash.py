"""Near-duplicates: SimHash fingerprints, tiled exact comparison, groups; and groups by the Jaccard similarity of shingles,
whose candidates are near by a wider SimHash."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, map_columns, removed, segments, shared_dir, stored

BITS = 64
#: Comparisons of fingerprints that a task makes, about a minute's.
PAIRS_IN_A_TASK = 10**9


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 values (seed 42) of a text's shingles, in order; none of a blank text, one of a text of fewer words."""
    got, w = [], []
    for part in segments((text or "").encode("utf-8", "replace").lower()):
        w = w[len(w) - words + 1 :] if len(w) >= words else w
        w += part.split()
        if len(w) >= words:
            parts = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
            got.append(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(w) - words + 1))
    if not got:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    return np.concatenate(got)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits of a text: majority of the XXH64 values (seed 42) of its shingles, as a signed integer.

    Null, empty and blank texts have fingerprint 0; a text of fewer words is one shingle.
    """
    h = shingles(text, words)
    n = len(h)
    if not n:
        return 0
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):  # a very long text costs no more memory
        part = h[at : at + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def _fingerprints(doc_id: list, text: list, words: int) -> dict:
    return {"doc_id": doc_id, "fp": [fingerprint(t, words) for t in text]}


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every row; only doc_id and text are read."""
    return map_columns(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), _fingerprints, "doc_id bigint, fp bigint", words=words)


def joined_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs (i, j) are linked: each takes the smallest it reaches."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, low, high = i[differ], j[differ], np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(label, high, low)
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def agree(x: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Of each exclusive-or (a row of words): whether all bits of one of the blocks, given as masks, are zero."""
    out, left = np.zeros(len(x), bool), np.arange(len(x))
    for mask in blocks:
        if not len(left):
            break
        same = ~(x[left] & mask).any(axis=1)
        out[left[same]] = True
        left = left[~same]
    return out


def tile_links(fp: np.ndarray, radius: int, part: np.ndarray, blocks: np.ndarray, tile: int = 256, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two labels of each fingerprint (a row of 64-bit words), each a member of its group: of the groups that all pairs within `radius` bits join,
    compared exactly; and of those that the pairs join which other sets compare: those that agree on one of `blocks` (masks), and those of one part where there are several.

    Sorted by population count and cut into tiles; a pair of tiles whose counts differ by
    more than the radius is skipped, the rest is exclusive-or and bit counts: of the first words, where `first` bounds those, and
    of all words of the pairs within it. Groups are kept as labels, so a dense set yields a forest, not its square.
    """
    pop = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.lexsort((*fp.T[::-1], pop))
    fp, pop, part = fp[order], pop[order], part[order]
    label, known, head = np.arange(len(fp)), np.arange(len(fp)), np.ascontiguousarray(fp[:, 0])
    parts = bool((part != part[0]).any())
    elsewhere = parts or len(blocks) > 0
    cuts = range(0, len(fp), tile)
    for a in cuts:
        x, top = head[a : a + tile], pop[min(a + tile, len(fp)) - 1]
        for b in range(a, len(fp), tile):
            if pop[b] - top > radius:
                break
            near = np.bitwise_count(x[:, None] ^ head[None, b : b + tile]) <= (radius if first is None else first)
            i, j = np.nonzero(near)
            i, j, joined = i + a, j + b, known if elsewhere else label
            more = joined[i] != joined[j]
            i, j = i[more], j[more]
            if not len(i):
                continue
            bits = fp[i] ^ fp[j]
            if fp.shape[1] > 1:
                within = np.bitwise_count(bits).sum(axis=1, dtype=np.int64) <= radius
                i, j, bits = i[within], j[within], bits[within]
            label = joined_labels(label, i, j)
            if elsewhere:
                other = agree(bits, blocks)
                if parts:
                    other |= part[i] == part[j]
                known = joined_labels(known, i[other], j[other])
    out = np.empty((2, len(fp)), np.int64)
    out[:, order] = order[label], order[known]
    return out[0], out[1]


def _forest(node: np.ndarray, label: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Links that join the groups of `label`, one fewer than it has groups of `known`."""
    own = (known == np.arange(len(node))) & (label != known)
    return pa.RecordBatch.from_pydict({"u": pa.array(node[own]), "v": pa.array(node[label[own]])})


def _compare(radius: int, blocks: np.ndarray, first: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, block, part, id, words of the fingerprint; none where the id is its only one) come sorted by key; a key's rows may span batches.
        All rows of a key have one block: pairs that agree on one before it are linked there."""
        key, held = None, []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            fp = rows[:, min(3, rows.shape[1] - 1) :].view(np.uint64)
            return _forest(rows[:, 2], *tile_links(fp, radius, rows[:, 1], blocks[: rows[0, 0]], first=first))

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)], axis=1)
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for s, e in zip([0, *edges], [*edges, len(keys)], strict=True):
                if s == e:
                    continue
                if keys[s] != key:
                    if sum(map(len, held)) > 1:
                        yield flush()
                    key, held = keys[s], []
                held.append(rows[s:e])
        if sum(map(len, held)) > 1:
            yield flush()

    return run


def links(distinct: DataFrame, path: str, radius: int = 2, most: int = 4096) -> DataFrame:
    """Links (u, v) that join exactly the groups of all pairs within `radius` bits.

    distinct: one row per fingerprint. Two fingerprints within r bits agree on one of r + 1
    blocks, so each block's value deals them out to sets; a set is compared whole. A set of
    more than `most` is split by population count and hash into tiles, and each tile meets
    the tiles within the radius: no pair is lost and no task holds more than two tiles. What a block before or a tile alone joins is linked once.
    """
    step = -(-BITS // (radius + 1))
    masks = np.array([[((1 << min(step, BITS - i * step)) - 1) << i * step] for i in range(radius + 1)], np.uint64)
    blocks = F.array(
        *[
            F.struct(
                F.lit(i).alias("b"),
                F.shiftrightunsigned("fp", i * step).bitwiseAND(F.lit((1 << min(step, BITS - i * step)) - 1)).alias("x"),
            )
            for i in range(radius + 1)
        ]
    )
    dealt = distinct.select("fp", F.explode(blocks).alias("k")).select("fp", "k.b", "k.x")
    sizes = dealt.groupBy("b", "x").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes, f"{path}/sizes")
    sized = dealt.join(sizes, ["b", "x"])
    plain = sized.where(F.col("n") <= most).select(F.xxhash64("b", "x").alias("key"), "b", F.lit(0).cast("bigint").alias("part"), "fp")
    hot = sized.where(F.col("n") > most).withColumn("p", F.bit_count("fp"))
    subs = stored(
        hot.groupBy("b", "x", "p").agg(F.count("*").alias("c")).withColumn("t", F.ceil(F.col("c") / (most // 2)).cast("int")), f"{path}/tiles"
    )
    tiles = subs.select("b", "x", "p", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("s"))
    near = F.explode(F.sequence(F.lit(0), F.lit(radius)))
    other = tiles.select("b", "x", F.col("p").alias("p2"), F.col("s").alias("s2"))
    pairs = tiles.withColumn("d", near).withColumn("p2", F.col("p") + F.col("d")).join(other, ["b", "x", "p2"]).where("p < p2 or s <= s2")
    ends = pairs.select("b", "x", F.xxhash64("b", "x", "p", "s", "p2", "s2").alias("key"), F.array(F.struct("p", "s"), F.struct(F.col("p2").alias("p"), F.col("s2").alias("s"))).alias("e"))
    ends = ends.select("b", "x", "key", F.explode(F.array_distinct("e")).alias("e")).select("b", "x", "key", "e.p", "e.s")
    member = hot.join(subs.select("b", "x", "p", "t"), ["b", "x", "p"]).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("t")).cast("int"))
    split = member.join(ends, ["b", "x", "p", "s"]).select("key", "b", F.xxhash64("p", "s").alias("part"), "fp")
    # As many tasks as the comparisons ask for, a fixed number that is not merged: a set of n has n * n / 2, a split one at most 5 times as many by tiles.
    pairs_all = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    tasks = int(min(100_000, max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs_all // PAIRS_IN_A_TASK)))
    return plain.unionByName(split).repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_compare(radius, masks), "u bigint, v bigint")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    component_id is the smallest doc_id among all documents reachable over links of at most
    `radius` bits. Nulls: a null text counts as empty; a null doc_id stays, and takes part
    in its group without being its smallest. Repeated rows stay. Empty tables give no rows.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    fps = stored(fingerprints(docs, words), f"{path}/fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), f"{path}/distinct")
    found = stored(links(distinct.select("fp"), path, radius), f"{path}/links")
    grouped = stored(components(found, path), f"{path}/groups")
    removed(spark, *[f"{path}/{name}" for name in ("links", "sizes", "tiles")])
    lows = distinct.join(grouped.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    of = lows.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


#: The wide fingerprint has BLOCKS blocks of STEP bits, which deal texts out, and is compared by its first NEAR_WORDS words. A bit differs with chance
#: acos(2 s / (1 + s)) / pi, 0.15 at a similarity s of 0.8: a pair at 0.8 shares no block with chance (1 - 0.85 ** 12) ** 64 = 7e-5, a more similar one with less.
BLOCKS, STEP, NEAR_WORDS = 64, 12, 3
#: Bits that may differ in the first word and in all that are compared: over five standard deviations above the mean of a pair at 0.8. Unrelated texts differ in 32 and 96.
NEAR_FIRST, NEAR = 24, 58
#: Masks of the blocks that lie in the words compared.
_MASKS = np.packbits(np.repeat(np.eye(NEAR_WORDS * BITS // STEP, dtype=np.uint8), STEP, axis=1), axis=1).view(np.uint64)
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, BLOCKS * STEP // BITS, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles, sorted; a blank text has one of its own, 0."""
    h = np.unique(shingles(text, words))
    return h if len(h) else np.zeros(1, np.uint64)


def wide_bits(h: np.ndarray) -> np.ndarray:
    """The wide fingerprint's bits: set where over half the shingles' hashes, mixed with a seed for each word, have theirs set."""
    votes = np.zeros(BLOCKS * STEP, np.int64)
    for at in range(0, len(h), 255):  # so that a byte holds the votes
        z = h[at : at + 255, None] + _SEEDS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        votes += np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * votes > len(h)).astype(np.uint8)


def dealt_by(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A key of each block: its place and value. Texts of few shingles, whose bits differ more, also go by each of those."""
    blocks = bits.reshape(BLOCKS, STEP) @ (1 << np.arange(STEP)) + (np.arange(BLOCKS) << STEP)
    return np.concatenate([blocks, -1 - (h >> np.uint64(33)).astype(np.int64)] if len(h) < 6 else [blocks]).astype(np.int32)


def _sketches(k: list, doc_id: list, text: list, words: int) -> dict:
    sets = [shingle_set(t, words) for t in text]
    node = [xxhash.xxh64_intdigest(h.tobytes()) for h in sets]
    bits = [wide_bits(h) for h in sets]
    fp = [np.packbits(b[: NEAR_WORDS * BITS]).view(np.int64) for b in bits]
    return {"k": k, "doc_id": doc_id, "node": np.array(node, np.uint64).view(np.int64), "fp": fp, "blocks": [dealt_by(h, b) for h, b in zip(sets, bits, strict=True)]}


def near_links(nodes: DataFrame, most: int = 8192) -> DataFrame:
    """Links (u, v) that join all nodes (node, fp, blocks) which share a block and whose fingerprints differ in at most NEAR bits.

    A block's value deals the nodes out to sets; a set is compared whole, tile by tile. One of over `most` nodes is split, and each pair of its parts meets.
    What a block before (of the words compared) or a part alone joins is linked once, so that links grow with the nodes, not with the blocks and parts that they share.
    """
    spark = nodes.sparkSession
    dealt = nodes.select("node", *[F.col("fp")[i].alias(f"w{i}") for i in range(NEAR_WORDS)], F.explode("blocks").alias("x"))
    hot = dealt.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > most).select("x", F.ceil(F.col("n") / (most // 2)).cast("int").alias("t"))
    split = dealt.join(hot, "x", "left").withColumn("t", F.coalesce("t", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
    met = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    block = F.when(F.col("x") < 0, BLOCKS).otherwise(F.shiftright("x", STEP))
    met = met.select(F.xxhash64("x", F.least("s", "o"), F.greatest("s", "o")).alias("key"), block.alias("block"), F.col("s").alias("part"), "node", *[f"w{i}" for i in range(NEAR_WORDS)])
    sets = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return sets.mapInArrow(_compare(NEAR, _MASKS, NEAR_FIRST), "u bigint, v bigint").distinct()


def similar(sets: list[np.ndarray], similarity: float, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two labels of each set: the first of the sets reachable over pairs of at least that Jaccard similarity, all compared; and over
    those pairs that other tiles compare, which are of one part where there are several."""
    size = np.array([len(h) for h in sets])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    label, known, mark = np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(values), bool)
    parts = bool((part != part[0]).any())
    for i in range(len(sets) - 1):
        own = at[start[i] : start[i] + size[i]]
        mark[own] = True
        both = np.add.reduceat(mark[at[start[i + 1] :]], start[i + 1 :] - start[i + 1], dtype=np.int64)
        mark[own] = False
        j = np.flatnonzero((1 + similarity) * both >= similarity * (size[i] + size[i + 1 :]) - 1e-6) + i + 1
        label = joined_labels(label, np.full(len(j), i), j)
        if parts:
            j = j[part[j] == part[i]]
            known = joined_labels(known, np.full(len(j), i), j)
    return label, known


def _verify(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, part, node, text) come sorted by key; a key's rows may span batches."""
        key, parts, nodes, sets = None, [], [], []

        def flush() -> pa.RecordBatch:
            return _forest(np.array(nodes, np.int64), *similar(sets, similarity, np.array(parts)))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k, own, node, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if k != key:
                        if len(sets) > 1:
                            yield flush()
                        key, parts, nodes, sets = k, [], [], []
                    parts.append(own)
                    nodes.append(node)
                    sets.append(shingle_set(text, words))
        if len(sets) > 1:
            yield flush()

    return run


def row_key() -> Column:
    """Rows that share it have the same doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = 512) -> DataFrame:
    """(k, doc_id, component) of every row of docs; k is its row_key(). Groups are joined by the pairs whose sets of
    shingles have at least that Jaccard similarity; a group can be a chain.

    Texts of one set are one node, with a SimHash of BLOCKS * STEP bits. Nodes that share a block of it and lie within NEAR bits are
    candidates, and so are those joined over others; each set of candidates is compared whole by the sets of their shingles. One of over `tile` nodes is split
    into tiles, and each pair of tiles meets.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    source = docs.select(row_key().alias("k"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(map_columns(source, _sketches, "k bigint, doc_id bigint, node bigint, fp array<bigint>, blocks array<int>", words=words), f"{path}/rows")
    nodes = stored(rows.groupBy("node").agg(F.min("k").alias("k"), F.any_value("fp").alias("fp"), F.any_value("blocks").alias("blocks")), f"{path}/nodes")
    edges = near_links(nodes)
    near = stored(components(stored(edges, f"{path}/edges"), f"{path}/near"), f"{path}/candidates")
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("t"))
    at = F.pmod(F.xxhash64("node"), F.col("t")).cast("int")
    wanted = near.join(sizes, "root").join(nodes.select("node", "k"), "node").select("k", "node", "root", "t", at.alias("s"))
    texts = source.select("k", "text").join(stored(wanted, f"{path}/wanted"), "k").dropDuplicates(["node"])
    other = texts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    met = other.select(F.xxhash64("root", F.least("s", "o"), F.greatest("s", "o")).alias("key"), F.col("s").alias("part"), "node", "text")
    pairs = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key").mapInArrow(_verify(words, similarity), "u bigint, v bigint")
    grouped = stored(components(stored(pairs, f"{path}/pairs"), path), f"{path}/groups")
    removed(spark, *[f"{path}/{name}" for name in ("nodes", "edges", "near", "candidates", "wanted", "pairs")])
    of = rows.select("k", "doc_id", "node").join(grouped.select("node", "root"), "node", "left")
    return of.select("k", "doc_id", F.coalesce("root", "node").alias("component"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of similar texts: that of the smallest doc_id, of rows that share it that of the
    smallest row_key(). A row without doc_id stays only where its group has no other. Null, empty and blank texts are one
    group; of rows alike in both one stays, whichever, if their other columns differ. All columns stay, of any names. Empty tables give no rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k"))["k"]
    kept = similar_groups(docs, words, similarity).groupBy("component").agg(first.alias("k")).select("k")
    rows = docs.select(row_key().alias("k"), F.struct(*docs.columns).alias("row"))
    return rows.join(kept, "k", "left_semi").dropDuplicates(["k"]).select("row.*")
