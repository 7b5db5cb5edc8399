"""Token counts kept up to date by deltas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, shared_dir, stored

#: A change: op is insert, delete or revise; seq orders the changes of a batch to one document.
CHANGE = "seq bigint, op string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"
KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
STATE = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint"
COUNTED = "struct<source: string, lang: string, n_tokens: bigint>"
#: A run's rows: what a document counts since then; null where it is gone.
ENTRY = f"doc_id bigint, tokenizer string, now {COUNTED}"
TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_batches bigint"
LEDGER = "version int, name string, touched array<int>, rows bigint, replaces array<int>"


class TokenRollup:
    """Totals by source, language and tokenizer version, and what each document counts now.

    All is written tables in one folder. The state is a family of runs: a batch writes the documents whose count it changes, and where the
    runs before it are less than twice as large, takes them in and replaces them. So there are few runs, each of a size of its own, and a small batch writes little
    however large the state is. A run lies in `buckets` folders by a hash of (doc_id, tokenizer), of which a batch reads those that its changes fall into. A batch is named;
    one that is committed already changes nothing, so a driver that fails may send it again. Its deltas are the
    difference between a document's old and new count: an insert of a document that is there revises it, a delete or
    revision of one that is not does nothing. One driver at a time may commit; if two did, the later one's commit fails.

    Changes without doc_id or tokenizer are left out of all totals. Of several changes of one batch to a document the last by
    seq holds, and of those alike the one with most tokens, then by source and language; so rows that repeat count once. A
    null count is 0; null sources and languages are groups. A group whose documents are all gone stays with zeros. An
    empty batch is committed and changes nothing. Columns besides those of CHANGE are not read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path or shared_dir(spark), buckets
        ledger = self._ledger()
        self.version, self.done = max((r["version"] for r in ledger), default=-1), {r["name"] for r in ledger}
        self.runs: dict[int, tuple[set[int], int]] = {}  # version: its folders and rows, oldest first
        for r in sorted(ledger, key=lambda r: r["version"]):
            self._took(r["version"], r["touched"], r["rows"], r["replaces"])
        self.stale: list[str] = []

    def _took(self, version: int, touched: list[int], rows: int, replaces: list[int]) -> None:
        self.runs = {v: r for v, r in self.runs.items() if v not in replaces}
        if rows:
            self.runs[version] = (set(touched), rows)

    def _ledger(self) -> list:
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # no batch yet

    def _entries(self, versions: list[int], buckets: set[int] | None = None) -> DataFrame:
        """(doc_id, tokenizer, now, run) of some runs, as far as they lie in the buckets."""
        out = self.spark.createDataFrame([], f"{ENTRY}, run int")
        for v in versions:
            folders = self.runs[v][0] if buckets is None else self.runs[v][0] & buckets
            if folders:
                run = self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/state-{v}/bucket={b}" for b in sorted(folders)])
                out = out.unionByName(run.withColumn("run", F.lit(v)))
        return out

    @property
    def state(self) -> DataFrame:
        """(doc_id, tokenizer, source, lang, n_tokens) of every document that counts."""
        return _latest(self._entries(list(self.runs))).where("now is not null").select(*KEY, "now.*")

    @property
    def totals(self) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/totals-{self.version}")

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Applies a batch; False if it was committed before."""
        if name in self.done:
            return False
        v = self.version + 1
        # Of a document's changes in order count the last insert or delete, and the last count given.
        order = F.struct("seq", "n_tokens", "source", "lang")
        kind = F.max_by("op", F.when(F.col("op").isin("insert", "delete"), order)).alias("kind")
        new = F.max_by(F.struct("source", "lang", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), F.when(F.col("op").isin("insert", "revise"), order)).alias("new")
        changed = changes.where("doc_id is not null and tokenizer is not null").groupBy(*KEY).agg(kind, new, F.lit(True).alias("touched"))
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")
        changed = stored(changed.withColumn("bucket", bucket), f"{self.path}/changed-{v}")
        touched = {r["bucket"] for r in changed.select("bucket").distinct().collect()}  # at most self.buckets numbers
        known = self._entries(list(self.runs), touched).join(changed.select(*KEY), KEY, "left_semi")
        both = changed.join(_latest(known).withColumnRenamed("now", "was"), KEY, "left")
        stays = F.coalesce(F.col("kind") == "insert", F.col("was").isNotNull())
        moved = both.withColumn("now", F.when(stays, F.coalesce("new", "was"))).where(~F.col("was").eqNullSafe(F.col("now"))).select(*KEY, "was", "now", "bucket")
        moved = stored(moved, f"{self.path}/moved-{v}")
        rows, replaces = moved.count(), []
        own: set[int] = set()
        for old in reversed(self.runs) if rows else ():
            if self.runs[old][1] >= 2 * rows:
                break
            replaces.append(old)
            rows += self.runs[old][1]
        totals = self.totals
        if rows:
            run = moved.select(*KEY, "now")
            if replaces:
                run = _latest(self._entries(replaces).unionByName(run.withColumn("run", F.lit(v))))
            if len(replaces) == len(self.runs):
                run = run.where("now is not null")  # nothing older that they hide
            run.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state-{v}")
            own = self._folders(v)
            signed = moved.select("tokenizer", F.inline(F.array(F.struct(F.lit(-1).alias("sign"), F.col("was").alias("x")), F.struct(F.lit(1).alias("sign"), F.col("now").alias("x")))))
            deltas = (
                signed.where("x is not null").groupBy("x.source", "x.lang", "tokenizer")
                .agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("x.n_tokens")).alias("n_tokens")).withColumn("n_batches", F.lit(1).cast("bigint"))
            )
            totals = totals.unionByName(deltas).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_batches")])
        totals.write.mode("overwrite").parquet(f"{self.path}/totals-{v}")
        # The row in the ledger is the commit: without it the version is written again.
        row = (v, name, sorted(own), rows if own else 0, replaces)
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        if sum(r["version"] == v for r in self._ledger()) > 1:
            raise RuntimeError(f"version {v} of {self.path} was committed by another driver as well")
        # What the version before the last one alone needs goes.
        removed(self.spark, *self.stale, f"{self.path}/changed-{v}", f"{self.path}/moved-{v}", f"{self.path}/totals-{v - 2}")
        self.stale = [f"{self.path}/state-{old}" for old in replaces]
        self.version = v
        self._took(v, *row[2:])
        self.done.add(name)
        return True

    def _folders(self, version: int) -> set[int]:
        """The buckets that a run has folders of."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state-{version}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return {int(name.partition("=")[2]) for name in (f.getPath().getName() for f in found) if name.startswith("bucket=")}


def _latest(entries: DataFrame) -> DataFrame:
    """(doc_id, tokenizer, now) of each document's newest run."""
    return entries.groupBy(*KEY).agg(F.max_by("now", "run").alias("now"))


def changes_of(docs: DataFrame, op: str, tokenizer: str, count) -> DataFrame:
    """A batch of one kind from rows of documents; count is a column of the text's tokens."""
    return docs.select(
        F.lit(0).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.col("doc_id").cast("bigint"), F.col("source").cast("string"),
        F.col("lang").cast("string"), F.lit(tokenizer).alias("tokenizer"), count.cast("bigint").alias("n_tokens"),
    )
