"""Document quality: regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, segments, shared_dir, stored

_CLASSES = [
    range(65, 91), range(97, 123), range(48, 58), b".,;:", b"!?", b"#*$%&|<>", b"'\"()[]{}-_/\\+=@^~`", range(128, 256), b" \t\n\r\x0b\x0c",
    [*range(9), *range(14, 32), 127],
]
_MEMBERS = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _MEMBERS[list(_c), _i] = 1
FEATURES = len(_CLASSES) + 11


def statistics(text: str | None) -> np.ndarray:
    """Numbers of one whole text: sizes, shares of kinds of bytes, shapes of words and lines, all
    on a log or share scale. Null and empty texts have the numbers of no words."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if len(data) < 1 << 20 else sum(np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in segments(data))
    kinds: Counter = Counter()
    sizes = np.zeros(256, np.int64)  # words by length; longer ones are added up beside
    long = [0, 0, 0]
    for part in segments(data):
        words = part.split()
        kinds.update(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sizes += np.bincount(size[size < 256], minlength=256)
        over = size[size >= 256].astype(float)
        long = [a + b for a, b in zip(long, (len(over), over.sum(), (over**2).sum()), strict=True)]
    m = max(1, int(sizes.sum() + long[0]))
    lengths = np.arange(256)
    mean = (sizes @ lengths + long[1]) / m
    square = (sizes @ lengths**2 + long[2]) / m
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = counts[counts > 0] / n
    shares = np.log(counts @ _MEMBERS / n + 1e-3)
    lines_n = max(1, len(lines))
    rest = [
        np.log1p(len(data)), np.log1p(mean), np.log1p(np.sqrt(max(0.0, square - mean**2) + 1e-9)),
        np.log((len(kinds) + 1) / (m + 1)), np.log(max(kinds.values(), default=0) / m + 1e-3),
        np.log(1 - len(set(lines)) / lines_n + 1e-2), np.log1p(m / lines_n), -(p * np.log(p)).sum(),
        np.log((sizes[21:].sum() + long[0]) / m + 1e-3), np.log(sizes[:3].sum() / m + 1e-3),
        np.log(sum(w.isupper() for w in kinds) / max(1, len(kinds)) + 1e-2),
    ]
    return np.concatenate([shares, rest])


def _features(doc_id: list, text: list) -> dict:
    return {"doc_id": doc_id, "x": [statistics(t) for t in text]}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row; only doc_id and text are read."""
    return map_columns(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), _features, "doc_id bigint, x array<double>")


class Discriminant(NamedTuple):
    """Two Gaussians with cached Cholesky factors (inverted), and log prior odds."""

    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    odds: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        d = [(((z - c) @ f.T) ** 2).sum(axis=1) + ld for c, f, ld in zip(self.centres, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(((d[0] - d[1]) / 2 + self.odds) / self.temper, -30, 30)))


def fit(labelled: DataFrame, shrinkage: float = 0.15, temper: float = 3.0) -> Discriminant | None:
    """From rows (x, y) with y 0 or 1: class means and covariances, shrunk towards the diagonal.

    Counts, sums and sums of products are added up by Spark; the driver gets one row per class,
    whatever the data. None if a class has fewer than two rows.
    """
    pairs = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]
    rows = labelled.where("y in (0, 1)").groupBy("y").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(FEATURES)]).alias("s"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("p"),
    )
    return fitted({r["y"]: r for r in rows.collect()}, shrinkage, temper)


def fitted(got: dict, shrinkage: float = 0.15, temper: float = 3.0) -> Discriminant | None:
    """The same from the sums of each class: n, s (of the features) and p (of their products, upper triangle by rows)."""
    pairs = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]
    if any(c not in got or got[c]["n"] < 2 for c in (0, 1)):
        return None
    n = np.array([got[c]["n"] for c in (0, 1)], float)
    s = np.array([got[c]["s"] for c in (0, 1)])
    second = np.zeros((2, FEATURES, FEATURES))
    for c in (0, 1):
        for (i, j), v in zip(pairs, got[c]["p"], strict=True):
            second[c, i, j] = second[c, j, i] = v
    mean = s.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.einsum("cii->i", second) / n.sum() - mean**2, 1e-8))
    centres = (s / n[:, None] - mean) / scale
    factors, dets = [], []
    for c in (0, 1):
        m = s[c] / n[c]
        cov = (second[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + 0.05 * np.eye(FEATURES)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(mean, scale, centres, np.array(factors), np.array(dets), float(np.log(n[1] / n[0])), temper)


def _scores(doc_id: list, x: list, model: Discriminant | None) -> dict:
    return {"doc_id": doc_id, "score": model.score(np.array(x)) if model and x else [0.5] * len(x)}


def training_fold(mod: int, left_out: int):
    """crc32 of doc_id as text, modulo `mod`, is `left_out`: such rows are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == left_out, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, path: str) -> tuple[DataFrame, Discriminant | None]:
    """Features of every row, written once; the model of the labelled rows outside the held-out fold."""
    x = stored(features(docs), f"{path}/features")
    y = labels.where("doc_id is not null and quality is not null").where(~training_fold(5, 0)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    return x, fit(x.join(y, "doc_id").select("x", "y"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Trained on all labelled rows of the other four folds; labels, lang, source and doc_id are
    no inputs. Null and empty texts get the score of a text without words; rows without
    doc_id are scored and not held out. Without labels of both kinds every score is 0.5.
    """
    x, model = trained(docs, labels, shared_dir(docs.sparkSession))
    out = map_columns(x, _scores, "doc_id bigint, score double", rows=4096, model=model)
    return out.select("doc_id", training_fold(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """The rows of docs whose score reaches the threshold; all columns stay, of any names. Each row is scored on its own
    text beside it, so repeated and null doc_ids are no matter. The model learns from at most `most` labelled rows, least by hash,
    so their ids can be broadcast and no text is shuffled; the statistics of the other rows are made once."""
    y = labels.where("doc_id is not null and quality is not null").where(~training_fold(5, 0)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    y = F.broadcast(stored(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), f"{shared_dir(docs.sparkSession)}/labels"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).join(y, "doc_id", "left_semi")
    model = fit(features(rows).join(y, "doc_id").select("x", "y"))
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([statistics(t) for t in part.column(names.index("text")).to_pylist()])
                keep = model.score(x) >= threshold if model else np.full(len(x), 0.5 >= threshold)
                yield part if keep.all() else part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
