"""Exact substring dedup over a logarithmic family of suffix arrays.

Two equal strings of `length` bytes hold the same least k-gram at the same place. So it is
enough to index the suffixes that start at such k-grams (about 1.6 in 100 positions): equal
strings meet at one suffix key. A suffix array here is a table sorted by the fingerprint of
its suffixes' first k bytes, one row per distinct key. Each batch gets one; it is merge-scanned
against every level (a sort-merge join of bucketed, sorted tables: no exchange), and levels
of equal size merge into one of the double size.

A whole table is cut by `cut`, `cut_digest` and `cleaned`, whose levels hold keys alone. Documents that
come in batches go to a `SubstringIndex`, whose levels hold places too, so that a batch is matched with all before.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, removed, shared_dir, stored

_RNG = np.random.default_rng(20200509)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Window starts that are held at once: a text of any length costs the same memory.
SEGMENT = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(n + n // 2, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """64-bit fingerprints of any substrings of one byte string."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        up, self.down = _powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int, n: int) -> np.ndarray:
        """Of the substrings of `size` bytes at 0, 1, ..., n - 1."""
        return _mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([x, pad]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = 200, k: int = 80) -> dict[str, np.ndarray]:
    """The suffixes to index: key (of k bytes at the anchor), cls (of all that its windows
    cover, with their place), start and n of the windows [start + i, start + i + length), i < n,
    and at, the anchor's distance from start.

    Every window belongs to the leftmost least of its k-grams, which depends on its own
    bytes alone. Texts shorter than `length` have none.
    """
    got: dict[str, list] = {"key": [], "cls": [], "start": [], "n": [], "at": []}
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        roll = Rolling(part)
        grams = roll.grams(k, len(part) - k + 1)
        least = _sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
        place = (least & _PLACE).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        n = np.diff(np.concatenate([start, [len(place)]]))
        anchor = place[start]
        whole = roll.of(start, start + n - 1 + length)
        got["key"].append(grams[anchor].view(np.int64))
        got["cls"].append(_mix(whole + (anchor - start).astype(np.uint64) * _BASE + n.astype(np.uint64)).view(np.int64))
        got["start"].append(start + at)
        got["n"].append(n)
        got["at"].append(anchor - start)
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in got.items()}


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _entries(k1: list, k2: list, text: list, length: int, k: int, batches: int) -> dict:
    out: dict[str, list] = {c: [] for c in ("key", "cls", "start", "n", "at")}
    counts = []
    for t in text:
        a = anchors(_bytes(t), length, k)
        counts.append(len(a["key"]))
        for c, v in out.items():
            v.append(a[c])
    many = np.array(counts)
    out = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
    k2s = np.array(k2, np.int64)
    return {
        "k1": np.repeat(np.array(k1, np.int64), many), "k2": np.repeat(k2s, many), "key": out["key"], "cls": out["cls"],
        "start": out["start"].astype(np.int32), "n": out["n"].astype(np.int16), "at": out["at"].astype(np.int16), "batch": np.repeat((k2s % batches).astype(np.int32), many),
    }


def _bands(k1: list, k2: list, text: list, marks: list, length: int) -> dict:
    """The windows of the suffixes in marks (key, start, n, at, c), eight by eight, by their distance
    from the anchor. All windows of a band hold its core of length - 7 bytes; with `before` and
    `after`, the seven bytes on either side, every window is known exactly. x from lo to hi is how many
    of the bytes before the core the band's windows take; first is where the widest of them starts."""
    got: dict[str, list] = {c: [] for c in ("k1", "k2", "key", "core", "before", "after", "lo", "hi", "first", "c")}
    powers = 256 ** np.arange(6, -1, -1, dtype=np.int64)
    seven = np.arange(7)
    for a, b, t, m in zip(k1, k2, text, marks, strict=True):
        data = _bytes(t)
        for x in m:
            s, n, at = x["start"], x["n"], x["at"]
            j = np.arange((at - n + 1) // 8, at // 8 + 1)
            low = max(0, s - 7)
            part = data[low : s + n + length + 7]
            roll = Rolling(part)
            core = s + at - 8 * j - low
            padded = np.concatenate([np.zeros(7, np.int64), np.frombuffer(part, np.uint8), np.zeros(length + 14, np.int64)])
            got["core"].append(roll.of(core, core + length - 7).view(np.int64))
            got["before"].append(padded[core[:, None] + seven] @ powers)
            got["after"].append(padded[core[:, None] + length + seven] @ powers)
            lo, hi = np.maximum(0, at - 8 * j - n + 1), np.minimum(7, at - 8 * j)
            got["lo"].append(lo.astype(np.int16))
            got["hi"].append(hi.astype(np.int16))
            got["first"].append((core + low - hi).astype(np.int32))
            for c, v in (("k1", a), ("k2", b), ("key", x["key"]), ("c", x["c"])):
                got[c].append(np.full(len(j), v, np.int64))
    kinds = {"first": np.int32, "lo": np.int16, "hi": np.int16}
    return {c: np.concatenate(v) if v else np.zeros(0, kinds.get(c, np.int64)) for c, v in got.items()}


def merged(spans: list) -> list[list[int]]:
    """Maximal runs of half-open intervals; those that touch become one."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut(k1: list, k2: list, text: list, spans: list) -> dict:
    runs, kept, n = [], [], []
    for t, m in zip(text, spans, strict=True):
        data = _bytes(t)
        r = merged(m)
        ends = [0, *(e for _, e in r)]
        kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in r), len(data)], strict=True)))
        runs.append([{"s": s, "e": e} for s, e in r])
        n.append(len(data))
    return {"k1": k1, "k2": k2, "n_bytes": n, "spans": runs, "kept": kept}


def _digest(doc_id: list, text: list, spans: list) -> dict:
    x = _cut(doc_id, doc_id, text, spans)
    return {
        "doc_id": doc_id, "n_bytes": x["n_bytes"],
        "n_removed": [sum(s["e"] - s["s"] for s in r) for r in x["spans"]], "n_spans": [len(r) for r in x["spans"]],
        "kept_sha256": [hashlib.sha256(k).hexdigest() for k in x["kept"]],
    }


NO_ID = -(2**63)

#: A suffix: its document, its key, its class, and the windows that it stands for.
ENTRY = "k1 bigint, k2 bigint, key bigint, cls bigint, start int, n smallint, at smallint"


class SuffixFamily:
    """Suffix arrays of batches in levels of 1, 2, 4, ... batches, as bucketed and sorted tables in the
    shared folder."""

    by: tuple[str, ...] = ("key",)

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.levels, self.name = spark, buckets, {}, f"laureate_sa_{uuid.uuid4().hex[:12]}"
        self.made, self.tables, self.path = 0, set(), shared_dir(spark)

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        self.tables.add(table)
        df.write.option("path", f"{self.path}/{table}").bucketBy(self.buckets, *self.by).sortBy(*self.by).saveAsTable(table)
        return table

    def _drop(self, *tables: str) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            removed(self.spark, f"{self.path}/{table}")
            self.tables.discard(table)

    def add(self, batch: DataFrame) -> list[str]:
        """Indexes a batch (key, ...) and returns SQL of the keys that it repeats: within
        itself, or of a level (a merge-scan of both sorted tables)."""
        own = batch.groupBy("key").agg(F.count("*").alias("c")).repartition(self.buckets, "key")
        table = self._write(own)
        found = [f"SELECT key FROM {table} WHERE c > 1"]
        seen = list(self.levels.values())
        path = shared_dir(self.spark)
        hits = self.spark.sql(found[0])
        for level in seen:
            hits = hits.unionByName(self.spark.sql(f"SELECT /*+ MERGE(a, b) */ a.key FROM {table} a JOIN {level} b ON a.key = b.key"))
        hits.write.parquet(path)
        self._settle(table)
        return [path]

    def _merged(self, a: str, b: str) -> DataFrame:
        return self.spark.sql(f"SELECT /*+ MERGE(a, b) */ coalesce(a.key, b.key) AS key, coalesce(a.c, 0) + coalesce(b.c, 0) AS c FROM {a} a FULL OUTER JOIN {b} b ON a.key = b.key")

    def _settle(self, table: str) -> None:
        """A new array of one batch becomes a level; while there is one of its size, both merge into one of the double size."""
        size = 1
        while size in self.levels:
            with_ = self.levels[size]
            grown = self._write(self._merged(table, with_))
            del self.levels[size]
            self._drop(table, with_)
            table, size = grown, size * 2
        self.levels[size] = table

    def close(self) -> None:
        """Drops all tables, also those that a failed step left."""
        self._drop(*list(self.tables))
        removed(self.spark, self.path)
        self.levels = {}


class PlacedFamily(SuffixFamily):
    """Levels of suffixes (ENTRY) with the document and place of each: what later batches are matched with. A key's
    suffixes are dealt out to SALTS buckets by their class, so that a passage of very many documents does not meet in one task."""

    SALTS = 16
    by = ("key", "salt")

    def add(self, batch: DataFrame, path: str) -> DataFrame:
        """Indexes a batch and returns its suffixes that share a key with another, with those of the levels that they meet.
        The levels are scanned as they lie; only the batch's distinct keys are moved, to each salt."""
        table = self._write(batch.withColumn("salt", F.pmod("cls", F.lit(self.SALTS)).cast("int")).repartition(self.buckets, *self.by))
        counts = stored(self.spark.table(table).groupBy("key").agg(F.count("*").alias("c")), f"{path}/counts")
        probe = counts.select("key", F.explode(F.sequence(F.lit(0), F.lit(self.SALTS - 1))).alias("salt")).hint("merge")
        met = self.spark.createDataFrame([], ENTRY)
        for level in self.levels.values():
            met = met.unionByName(self.spark.table(level).join(probe, list(self.by), "left_semi").drop("salt"))
        met = stored(met, f"{path}/met")
        keys = stored(counts.where("c > 1").select("key").unionByName(met.select("key")).distinct(), f"{path}/repeated")
        found = self.spark.table(table).drop("salt").join(keys, "key", "left_semi").unionByName(met)
        found = stored(found, f"{path}/matched")
        self._settle(table)
        return found

    def _merged(self, a: str, b: str) -> DataFrame:
        return self.spark.table(a).unionByName(self.spark.table(b)).repartition(self.buckets, *self.by)


class SubstringIndex:
    """Documents in batches: of each new one, what repeats in itself or in any batch before.

    What earlier batches were told stays as it was. The index keeps the texts and suffixes of all its batches, in the shared
    folder, until close(); it lives as long as its session. A batch costs its own work, a scan of the levels
    and of the texts, and its share of their merging: each suffix is rewritten once per doubling.
    """

    def __init__(self, spark: SparkSession, length: int = 200, k: int = 80, buckets: int | None = None):
        self.spark, self.length, self.k, self.path, self.made = spark, length, k, shared_dir(spark), 0
        self.family = PlacedFamily(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def add(self, docs: DataFrame) -> DataFrame:
        """(k1, k2, n_bytes, spans, kept) of every row of the batch, as `cut` returns them. Null texts are empty, rows that repeat
        are each other's copies, also over batches; an empty batch gives no rows and counts as one. A batch whose add fails
        in the end is indexed or not: make the index anew then."""
        source = stored(keyed(docs), f"{self.path}/texts/batch={self.made}")
        self.made += 1
        work = f"{self.path}/work-{self.made}"
        entries = map_columns(source, _entries, f"{ENTRY}, batch int", length=self.length, k=self.k, batches=1).drop("batch")
        matched = self.family.add(entries, work)
        texts = self.spark.read.schema(source.schema).parquet(*[f"{self.path}/texts/batch={i}" for i in range(self.made)])
        own = source.select("k1", "k2").distinct()
        spans = stored(_spans(texts, matched, work, self.length).join(own, ["k1", "k2"], "left_semi"), f"{self.path}/spans-{self.made}")
        removed(self.spark, work)
        return _cut_rows(source, spans)

    def close(self) -> None:
        """Drops all that the index keeps; results of add that were not written go with it."""
        self.family.close()
        removed(self.spark, self.path)


def keyed(docs: DataFrame, *more) -> DataFrame:
    """doc_id may be null or repeat; rows alike in it and in their text get the same spans. A null counts as NO_ID."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"), *more)


def repeated_spans(docs: DataFrame, length: int = 200, k: int = 80, batches: int = 4) -> DataFrame:
    """(k1, k2, spans) of the documents that hold a string of `length` bytes which also
    starts anywhere else; the spans may overlap, their union is what repeats."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    source = keyed(docs)
    map_columns(source, _entries, f"{ENTRY}, batch int", length=length, k=k, batches=batches).write.partitionBy("batch").parquet(f"{path}/entries")
    entries = spark.read.schema(f"{ENTRY}, batch int").parquet(f"{path}/entries")
    family = SuffixFamily(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits = []
    try:
        for b in range(batches):
            hits += family.add(entries.where(F.col("batch") == b).select("key"))
    finally:
        family.close()
    # Key lists are written before they are joined: then a hot key's rows can be split over tasks.
    repeated = stored(spark.read.schema("key bigint").parquet(*hits).distinct(), f"{path}/repeated")
    matched = stored(entries.select("k1", "k2", "key", "cls", "start", "n", "at").join(repeated, "key", "left_semi"), f"{path}/matched")
    removed(spark, f"{path}/entries", f"{path}/repeated", *hits)
    spans = stored(_spans(source, matched, path, length), f"{path}/spans")
    removed(spark, *[f"{path}/{name}" for name in ("matched", *STEPS)])
    return spans


#: Tables that _spans writes on its way.
STEPS = ("classes", "several", "bands", "alike", "mixed", "windows", "twice")


def _spans(source: DataFrame, matched: DataFrame, path: str, length: int) -> DataFrame:
    """(k1, k2, spans) from all suffixes that share a key with another; source holds the texts of their documents."""
    # Whole classes that occur twice repeat as they stand.
    classes = matched.groupBy("key", "cls").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "start", "n", "at")).alias("one"))
    classes = stored(classes, f"{path}/classes")
    span = lambda first, last: (F.col(first).alias("s"), (last + length).cast("int").alias("e"))
    same = matched.join(classes.where("c > 1").select("key", "cls"), ["key", "cls"], "left_semi")
    same = same.select("k1", "k2", *span("start", F.col("start") + F.col("n") - 1))
    # Where a key has several classes, bands of their windows are compared, then single windows.
    several = stored(classes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), f"{path}/several")
    marks = classes.join(several, "key", "left_semi").select("one.k1", "one.k2", F.struct("key", "one.start", "one.n", "one.at", "c").alias("mark"))
    marks = marks.groupBy("k1", "k2").agg(F.collect_list("mark").alias("marks"))
    texts = source.join(marks, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    columns = "k1 bigint, k2 bigint, key bigint, core bigint, before bigint, after bigint, lo smallint, hi smallint, first int, c bigint"
    bands = stored(map_columns(texts.select("k1", "k2", "text", "marks"), _bands, columns, length=length), f"{path}/bands")
    whole = ["key", "core", "before", "after", "lo", "hi"]
    alike = stored(bands.groupBy(*whole).agg(F.sum("c").alias("t"), F.min(F.struct("k1", "k2", "first")).alias("one")), f"{path}/alike")
    banded = bands.where("c = 1").join(alike.where("t > 1").select(*whole), whole, "left_semi")
    banded = banded.select("k1", "k2", *span("first", F.col("first") + F.col("hi") - F.col("lo")))
    mixed = stored(alike.groupBy("key", "core").agg(F.count("*").alias("m")).where("m > 1").select("key", "core"), f"{path}/mixed")
    windows = alike.join(mixed, ["key", "core"], "left_semi").withColumn("x", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))))
    windows = windows.select(
        "key", "core", "x", F.expr("before & (shiftleft(1L, 8 * x) - 1)").alias("b"), F.expr("shiftright(after, 8 * x)").alias("a"),
        "t", "one.k1", "one.k2", (F.col("one.first") + F.col("hi") - F.col("x")).alias("first"),
    )
    windows = stored(windows, f"{path}/windows")
    exact = ["key", "core", "x", "b", "a"]
    twice = windows.groupBy(*exact).agg(F.sum("t").alias("s"), F.count("*").alias("g")).where("s > 1 and g > 1").select(*exact)
    twice = stored(twice, f"{path}/twice")
    single = windows.where("t = 1").join(twice, exact, "left_semi").select("k1", "k2", *span("first", F.col("first")))
    return same.unionByName(banded).unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def cut(docs: DataFrame, length: int = 200, k: int = 80, batches: int = 4) -> DataFrame:
    """(k1, k2, n_bytes, spans array<struct<s, e>>, kept binary) of every row: its maximal
    repeated runs of bytes, and the rest, concatenated. Null texts are empty."""
    return _cut_rows(keyed(docs), repeated_spans(docs, length, k, batches))


def _cut_rows(source: DataFrame, spans: DataFrame) -> DataFrame:
    joined = source.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "spans")
    return map_columns(joined, _cut, "k1 bigint, k2 bigint, n_bytes bigint, spans array<struct<s:int,e:int>>, kept binary")


def cut_digest(docs: DataFrame, length: int = 200, k: int = 80, batches: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256. Nulls: a null text is empty; a null doc_id is returned as null. Repeated rows
    are each other's copies and stay as rows. Empty tables give no rows."""
    spans = repeated_spans(docs, length, k, batches)
    joined = keyed(docs, F.col("doc_id").cast("bigint").alias("doc_id")).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return map_columns(joined, _digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = 200, k: int = 80, batches: int = 4) -> DataFrame:
    """docs with the repeated bytes cut out of text (a character that loses a byte goes whole), and n_chars, where there
    is one, counted anew. All rows and columns stay, of any names; a null text stays null. Repeated rows are each other's
    copies: of both all goes that is `length` bytes long. Empty tables give no rows."""
    spans = repeated_spans(docs, length, k, batches)
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), F.struct(*names).alias("row"))
    joined = rows.join(spans, ["k1", "k2"], "left").select("row.text", "spans", "row")
    schema = T.StructType([T.StructField("new", T.StringType()), joined.schema["row"]])

    def run(batches_):
        for batch in batches_:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts, found = part.column(0).to_pylist(), part.column(1).to_pylist()
                cut_ = _cut(texts, texts, texts, found)
                new = [k.decode("utf-8", "ignore") if s else t for t, s, k in zip(texts, cut_["spans"], cut_["kept"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), part.column(2)], names=["new", "row"])

    out = joined.mapInArrow(run, schema)
    own = {"text": F.col("new").cast(docs.schema["text"].dataType)}
    if "n_chars" in names:
        own["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in names])
