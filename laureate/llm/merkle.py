"""Merkle manifest of a table: a tree over each source's documents, a tree over the sources' roots, a proof for every document.

Nodes are hex strings. A block of BLOCK consecutive nodes keeps each of its levels as one string of digests in a row, so
that parents are hashes of fixed-width substrings, and the siblings of a node the substrings beside it. The blocks' roots are the nodes
of the next tree above, until one is left. All of it is SQL functions; texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, shared_dir, stored

#: Children of a node, levels within a block, nodes of a block.
ARITY, HEIGHT = 3, 4
BLOCK = ARITY**HEIGHT
#: Characters of a digest, and of a run of siblings.
WIDTH = 64
RUN = ARITY * WIDTH

_POWERS = ", ".join(f"{ARITY**k}L" for k in range(40))
#: Levels above n nodes, as far as a block goes.
_STEPS = f"least({HEIGHT}, size(filter(array({_POWERS}), p -> p < n)))"
#: The string of the level above s: the hash of each run, the last of which may be shorter.
_PARENTS = f"array_join(transform(sequence(0, cast(ceil(length(s) / {RUN}) AS int) - 1), r -> sha2(substring(s, {RUN} * r + 1, {RUN}), 256)), '')"
#: All levels of a block, lowest first; the last one is its root.
_ALL_LEVELS = f"aggregate(filter(sequence(1, {HEIGHT}), j -> j <= steps), array(lowest), (levels, j) -> concat(levels, transform(slice(levels, -1, 1), s -> {_PARENTS})))"
#: Of node i of a block: what stands to its left and right in its run of each level, lowest first.
_K = f"cast(i div element_at(array({_POWERS}), j + 1) AS int)"
_OWN_PATH = f"""transform(slice(levels, 1, size(levels) - 1), (s, j) -> named_struct(
    'l', substring(s, {RUN} * cast({_K} div {ARITY} AS int) + 1, {WIDTH} * ({_K} % {ARITY})),
    'r', substring(s, {WIDTH} * ({_K} + 1) + 1, {WIDTH} * ({ARITY - 1} - {_K} % {ARITY}))))"""
PATH = "array<struct<l:string,r:string>>"


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the five values, each as its length in bytes, a colon and itself; `-` for null."""
    framed = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[framed(c.cast("string")) for c in (doc_id, source, lang, n_chars, text)]), 256)


def without_line_feeds(doc_id: Column, text: Column) -> Column:
    """The tampering of the contract: the text without line feeds where 2 divides the CRC-32 of doc_id in decimal; null where that changes nothing."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even & F.contains(text, F.lit("\n")), F.replace(text, F.lit("\n"), F.lit("")))


def positions(rows: DataFrame, group: str, order: list[str], path: str) -> DataFrame:
    """Adds pos (from 0 within the group, by `order`, nulls first) and n (rows of the group).

    Rows are dealt out by ranges of (group, order), so that a group of any size lies over many tasks. A task numbers its own
    rows; the number of rows of the group before them comes from one row per task and group.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, path).withColumn("_task", F.shiftright("_at", 33))
    share = dealt.groupBy(group, "_task").agg(F.count("*").alias("_own"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_own").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = share.select(F.col(group).alias("_g"), F.col("_task").alias("_t"), (before - F.col("_first")).alias("_shift"), F.sum("_own").over(whole).alias("n"))
    out = dealt.join(share, dealt[group].eqNullSafe(share["_g"]) & (dealt["_task"] == share["_t"]))
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_g", "_t", "_shift")


def blocks_above(nodes: DataFrame, carried: list[str], path: str) -> list[DataFrame]:
    """Written tables (grp, block, n, levels, members) of nodes (grp, pos, n, node): first theirs, then of their blocks' roots, up to one block per group.

    members are the carried columns of a block's nodes, in order. No row holds more than BLOCK nodes.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    while True:
        member = F.struct("pos", "node", *carried)
        held = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(member)).alias("_m"), F.max("n").alias("n"))
        held = held.select("grp", "block", "n", F.expr(_STEPS).alias("steps"), F.array_join(F.transform("_m", lambda m: m["node"]), "").alias("lowest"), F.transform("_m", lambda m: F.struct(*[m[c].alias(c) for c in ("pos", *carried)])).alias("members"))
        out.append(stored(held.select("grp", "block", "n", F.expr(_ALL_LEVELS).alias("levels"), "members"), f"{path}-{len(out)}"))
        if most <= BLOCK:
            return out
        nodes = out[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("levels", -1).alias("node"))
        most, carried = -(-most // BLOCK), []


def paths_below(stages: list[DataFrame], above: DataFrame, carried: list[str], told: list[str]) -> DataFrame:
    """(grp, node, path, and the columns `carried` and `told`) of every lowest node: path has what stands left and right of it, level by level up to
    the end of `above`, which gives (grp, up, told) for each group."""
    up = above.select("grp", F.lit(0).cast("bigint").alias("block"), "up", *told)
    for nth, stage in reversed(list(enumerate(stages))):
        mine = carried if nth == 0 else []
        over = up.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "up", *told)
        fields = "".join(f", '{c}', m.{c}" for c in mine)
        node = f"transform(members, (m, i) -> named_struct('block', m.pos, 'node', substring(levels[0], {WIDTH} * i + 1, {WIDTH}), 'up', concat({_OWN_PATH}, up){fields}))"
        joined = stage.join(over, stage["grp"].eqNullSafe(over["_g"]) & (stage["block"] == over["_b"]))
        up = joined.select("grp", F.explode(F.expr(node)).alias("x"), *told).select("grp", "x.*", *told)
    return up.drop("block").withColumnRenamed("up", "path")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row per row of docs.

    The leaf is the hash of doc_id, source, lang, n_chars and text. Leaves of a source, by doc_id, and sources' roots, by source, are
    hashed in runs of three until one node is left. proof_sha256 is the hash of the siblings from leaf to root; folded_root
    is made of them and the leaf, tampered with (without_line_feeds) or not; verified says whether it is the root.

    Nulls are leaves' values like others; a null source is a source of its own, first, and null doc_ids come first in their
    source and are not tampered with. Rows of one doc_id are put in order by their leaves; rows that repeat give equal leaves, with a proof each. One row alone is subroot and
    root, with the hash of nothing as proof. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    other = without_line_feeds(doc_id, text)
    tampered = F.when(other.isNotNull(), leaf(doc_id, source, lang, n_chars, other))
    leaves = docs.select(source.cast("string").alias("grp"), doc_id.cast("bigint").alias("doc_id"), leaf(doc_id, source, lang, n_chars, text).alias("node"), tampered.alias("tampered"))
    stages = blocks_above(positions(leaves, "grp", ["doc_id", "node", "tampered"], f"{path}/leaves"), ["doc_id", "tampered"], f"{path}/blocks")
    roots = stages[-1].select(F.lit(0).alias("all"), F.col("grp").alias("source"), F.element_at("levels", -1).alias("node"))
    sources = positions(roots, "all", ["source"], f"{path}/sources").withColumnRenamed("all", "grp")
    over = blocks_above(sources, ["source"], f"{path}/source-blocks")
    removed(spark, f"{path}/leaves", f"{path}/sources")
    root = over[-1].select("grp", F.expr(f"cast(array() AS {PATH})").alias("up"), F.element_at("levels", -1).alias("root"))
    above = paths_below(over, root, ["source"], ["root"]).select(F.col("source").alias("grp"), F.col("path").alias("up"), F.col("node").alias("subroot"), "root")
    out = paths_below(stages, above, ["doc_id", "tampered"], ["subroot", "root"])
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "node"), lambda a, x: F.sha2(F.concat(x["l"], a, x["r"]), 256))
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
