"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, segments
from .quality import training_fold
from .suffix_dedup import Rolling

#: What makes a word's input; the warm-up trains it, the rest of the training moves it a twentieth as much.
INPUTS = ("embed", "chars", "k", "kb")
#: Buckets of words; sizes of a word's and a character's embedding; the widths of a character's neighbourhood and of the states.
BUCKETS = 1 << 14
EMBED, CHARS, NEAR, HIDDEN = 12, 8, 5, 8
WINDOW, STRIDE = 32, 24

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Words(NamedTuple):
    """Words of some texts. of: for each word in order its distinct word; bucket, start and end of each distinct
    word, and chars, the bytes that start and end point into; counts: words of each text."""

    of: np.ndarray
    bucket: np.ndarray
    chars: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray


def inputs(texts: list[str | None]) -> Words:
    """Words are runs of letters and digits, lower-cased. A text is hashed one part at a time."""
    flat, hashes, starts, ends, counts, base = [], [], [], [], [], 0
    for t in texts:
        n = 0
        for part in segments((t or "").lower().encode("utf-8", "replace")):
            letter = np.concatenate([[False], _LETTER[np.frombuffer(part, np.uint8)], [False]])
            edge = np.flatnonzero(letter[1:] != letter[:-1])
            start, end = edge[::2], edge[1::2]
            hashes.append(Rolling(part).of(start, end) + (end - start).astype(np.uint64))
            starts.append(start + base)
            ends.append(end + base)
            flat.append(part)
            base += len(part)
            n += len(start)
        counts.append(n)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    kinds, first, of = np.unique(join(hashes, np.uint64), return_index=True, return_inverse=True)
    start, end = join(starts, np.int64)[first], join(ends, np.int64)[first]
    return Words(of.reshape(-1).astype(np.int32), (kinds % np.uint64(BUCKETS)).astype(np.int32), np.frombuffer(b"".join(flat), np.uint8), start, end, np.array(counts, np.int64))


def _spread(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters (n, NEAR), first of each word): all characters of those distinct words with their neighbours; 256 is none."""
    size = words.end[which] - words.start[which]
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(words.start[which] - first, size)
    c = np.append(words.chars, np.uint8(0)).astype(np.int16)
    low, high = np.repeat(words.start[which], size), np.repeat(words.end[which], size)
    near = [np.where((at + j >= low) & (at + j < high), c[(at + j).clip(0, len(words.chars))], 256) for j in range(-(NEAR // 2), NEAR // 2 + 1)]
    return np.stack(near, 1), first


def _characters(p: dict, near: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Convolved characters, and their highest values of each word, before the hyperbolic tangent."""
    conv = p["kb"] + sum((p["chars"] @ p["k"][j])[near[:, j]] for j in range(NEAR))
    return conv, np.maximum.reduceat(conv, first, axis=0)


def embedded(p: dict, words: Words) -> np.ndarray:
    """The input of each distinct word: its bucket's embedding and what its characters give."""
    out = p["embed"][words.bucket].copy()
    for at in range(0, len(out), 16384):
        which = np.arange(at, min(len(out), at + 16384))
        out[which] += np.tanh(_characters(p, *_spread(words, which))[1])
    return out


def parts_of(texts: list[str | None], chars: int):
    """Slices of about so many characters, of one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= chars):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of word places, of text): all overlapping windows; -1 pads, and a text without words has one empty window."""
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, int)
    many = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    place = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(place < counts[text][:, None], place + firsts[text][:, None], -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network(NamedTuple):
    """embed (BUCKETS, EMBED); chars (257, CHARS), k (NEAR, CHARS, EMBED), kb (EMBED); of each direction w (EMBED, 3 H), u (H, 3 H),
    b (3 H); attention a (2 H, 2 H), v; output o, c."""

    p: dict
    slope: float = 1.0
    shift: float = 0.0

    def gates(self, words: Words) -> np.ndarray:
        """What each distinct word gives the gates of both directions, bias included; the last row is no word."""
        w, b = np.concatenate([self.p["w0"], self.p["w1"]], 1), np.concatenate([self.p["b0"], self.p["b1"]])
        return np.concatenate([embedded(self.p, words) @ w + b, np.zeros((1, w.shape[1]), np.float32)])

    def logits(self, gates: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of windows over words whose gate inputs are the rows of `gates`; its last row is no word."""
        h = [_gru(gates[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN], place, self.p[f"u{d}"], d == 1)[0] for d in (0, 1)]
        return _pool(np.concatenate(h, 2), place >= 0, self.p)[0]


def _gru(gates: np.ndarray, place: np.ndarray, u: np.ndarray, back: bool, keep: bool = False):
    """States (windows, steps, HIDDEN) of words whose gate inputs, bias included, are rows of `gates`.
    Padding leaves the state as it is."""
    n, steps = place.shape
    out = np.zeros((n, steps, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    kept = {}
    full = (place >= 0).all(axis=0)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x = gates[place[:, t]]
        y = h @ u
        zr = x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = r * y[:, 2 * HIDDEN :]
        new += x[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        now = h - new
        now *= z
        now += new
        live = None if full[t] else (place[:, t] >= 0)[:, None]
        if live is not None:
            now = np.where(live, now, h)
        if keep:
            kept[t] = (h, z, r, new, y[:, 2 * HIDDEN :], True if live is None else live)
        out[:, t] = h = now
    return out, kept


def _pool(h: np.ndarray, live: np.ndarray, p: dict):
    e = np.tanh(h @ p["a"])
    s = np.where(live, e @ p["v"], -1e9)
    s[:, 0] = np.where(live.any(axis=1), s[:, 0], 0)
    w = np.exp(s - s.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    pooled = (w[:, :, None] * h).sum(axis=1)
    return pooled @ p["o"] + p["c"][0], (e, w, pooled)


def _added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of the rows that point to each."""
    flat = at[:, None].astype(np.int64) * rows.shape[1] + np.arange(rows.shape[1])
    return np.bincount(flat.ravel(), rows.ravel(), n * rows.shape[1]).reshape(n, -1).astype(np.float32)


def _step(p: dict, words: Words, place: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits and gradients of a batch of windows, by back-propagation through time."""
    live = place >= 0
    rows, at = np.unique(words.of[place[live]], return_inverse=True)
    made = _made(p, words, rows)
    x = np.zeros((*place.shape, EMBED), np.float32)
    x[live] = made[0][at.reshape(-1)]
    steps = np.arange(place.size).reshape(place.shape)
    pad = np.where(live, steps, -1)
    h, kept = [], []
    for d in (0, 1):
        gates = np.concatenate([x.reshape(-1, EMBED) @ p[f"w{d}"] + p[f"b{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
        out, k = _gru(gates, pad, p[f"u{d}"], d == 1, True)
        h.append(out)
        kept.append(k)
    h = np.concatenate(h, 2)
    logit, (e, w, pooled) = _pool(h, live, p)
    g = {}
    dl = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
    g["o"], g["c"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
    dpool = dl[:, None] * p["o"]
    dw = (h * dpool[:, None]).sum(axis=2)
    ds = w * (dw - (w * dw).sum(axis=1, keepdims=True)) * live
    de = ds[:, :, None] * p["v"] * (1 - e**2)
    g["v"] = (e * ds[:, :, None]).sum(axis=(0, 1))
    g["a"] = np.einsum("nti,ntj->ij", h, de)
    dh_all = w[:, :, None] * dpool[:, None] + de @ p["a"].T
    dx = np.zeros_like(x)
    for d in (0, 1):
        u, dh = p[f"u{d}"], np.zeros((len(place), HIDDEN), np.float32)
        gu, gates_g = np.zeros_like(u), np.zeros((*place.shape, 3 * HIDDEN), np.float32)
        for t in range(place.shape[1]) if d == 1 else range(place.shape[1] - 1, -1, -1):
            before, z, r, new, yn, alive = kept[d][t]
            dh = dh + dh_all[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            own = dh * alive
            dn = own * (1 - z) * (1 - new**2)
            dz = own * (before - new) * z * (1 - z)
            dr = dn * yn * r * (1 - r)
            dy = np.concatenate([dz, dr, dn * r], 1)
            gates_g[:, t] = np.concatenate([dz, dr, dn], 1)
            gu += before.T @ dy
            dh = np.where(alive, own * z + dy @ u.T, dh)
        flat = gates_g.reshape(-1, 3 * HIDDEN)
        g[f"u{d}"], g[f"b{d}"], g[f"w{d}"] = gu, flat.sum(axis=0), x.reshape(-1, EMBED).T @ flat
        dx += gates_g @ p[f"w{d}"].T
    return logit, g | _back(p, words, rows, made, _added(at.reshape(-1), dx[live], len(rows)))


def _made(p: dict, words: Words, rows: np.ndarray) -> tuple:
    """Inputs of some distinct words, with what their gradients need."""
    near, first = _spread(words, rows)
    conv, top = _characters(p, near, first)
    spelt = np.tanh(top)
    return p["embed"][words.bucket[rows]] + spelt, near, first, conv, top, spelt


def _back(p: dict, words: Words, rows: np.ndarray, made: tuple, gx: np.ndarray) -> dict:
    """Gradients of embeddings and characters from those of the words' inputs."""
    _, near, first, conv, top, spelt = made
    buckets, to = np.unique(words.bucket[rows], return_inverse=True)
    g = {"embed": (buckets, _added(to.reshape(-1), gx, len(buckets))), "k": np.zeros_like(p["k"]), "chars": np.zeros_like(p["chars"])}
    # The tangent's gradient goes to the characters that gave a word's highest values.
    size = np.diff(np.append(first, len(near)))
    best = conv == np.repeat(top, size, axis=0)
    gc = best * np.repeat(gx * (1 - spelt**2) / np.maximum(1, np.add.reduceat(best, first, axis=0, dtype=np.float32)), size, axis=0) if len(rows) else np.zeros((0, EMBED), np.float32)
    g["kb"] = gc.sum(axis=0)
    for j in range(NEAR):
        per = _added(near[:, j], gc, 257)
        g["k"][j] = p["chars"].T @ per
        g["chars"] += per @ p["k"][j].T
    return g


def _step_of_texts(p: dict, words: Words, texts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict]:
    """The same for whole texts whose logit is the logarithm of the mean exponential of their words' scores, x @ q: a warm-up of the
    inputs, in which a text's few telling words get its gradient."""
    first = np.cumsum(words.counts) - words.counts
    n = words.counts[texts]
    head = np.cumsum(n) - n
    of = words.of[np.arange(n.sum()) + np.repeat(first[texts] - head, n)]
    rows, at = np.unique(of, return_inverse=True)
    at = at.reshape(-1)
    made = _made(p, words, rows)
    s = (made[0] @ p["q"])[at]
    most = np.maximum.reduceat(s, head)
    e = np.exp(s - np.repeat(most, n))
    z = np.add.reduceat(e, head)
    logit = most + np.log(z / n) + p["qc"][0]
    dl = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
    ds = np.bincount(at, e * np.repeat(dl / z, n), len(rows)).astype(np.float32)
    return logit, {"q": made[0].T @ ds, "qc": np.array([dl.sum()], np.float32)} | _back(p, words, rows, made, ds[:, None] * p["q"])


def train(texts: list[str], y: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.01, drop: float = 0.15, seed: int = 3, warm_up: int = 10, rate_of_toxic: float = 0.0) -> Network:
    """A network from labelled texts. First the words' inputs are warmed up on whole texts (_step_of_texts), then the whole network
    learns from windows for `epochs` rounds, as many whatever the sample's size, moving the inputs little. All windows of the other texts are learnt from in each epoch; as a toxic
    text's label holds for some of its windows only, a quarter of them is (one at least), those that score highest. A share
    `drop` of the words is hidden from each step. Every fifth text of a class (the first as well) is left out of this and
    sets slope and shift of a text's highest logit; with the rate of toxic texts outside the sample, the odds go half of the way there.
    """
    rng = np.random.default_rng(seed)
    cell = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(np.float32)
    p = {
        "embed": np.zeros((BUCKETS, EMBED), np.float32), "chars": (rng.standard_normal((257, CHARS)) * 0.5).astype(np.float32), "k": cell(NEAR, CHARS, EMBED),
        "kb": np.zeros(EMBED, np.float32), "a": cell(2 * HIDDEN, 2 * HIDDEN), "v": cell(2 * HIDDEN), "o": cell(2 * HIDDEN), "c": np.zeros(1, np.float32),
    }
    for d in (0, 1):
        p |= {f"w{d}": cell(EMBED, 3 * HIDDEN), f"u{d}": cell(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    words = inputs(texts)
    place, text = windows(words.counts)
    own = np.zeros(len(texts), bool)
    for c in (0, 1):
        of = rng.permutation(np.flatnonzero(y == c))
        own[of[np.arange(len(of)) % 5 > 0]] = True
    p |= {"q": np.full(EMBED, EMBED**-0.5, np.float32), "qc": np.zeros(1, np.float32)}
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    net, step = Network(p), 0

    def follow(g: dict, rate: float, settled: float = 1) -> None:
        nonlocal step
        step += 1
        lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, v in g.items():
            at, v = v if k == "embed" else (slice(None), v)
            m1[k][at] = 0.9 * m1[k][at] + 0.1 * v
            # Words share one scale, so that those that tell the classes apart in many texts move most.
            m2[k][at] = 0.999 * m2[k][at] + 0.001 * (np.square(v).mean() if k == "embed" else v**2)
            p[k][at] -= (settled if k in INPUTS else 1) * lr * m1[k][at] / (np.sqrt(m2[k][at]) + 1e-8)

    weight_of = lambda yy: np.where(yy == 1, 0.5 / max(0.02, yy.mean()), 0.5 / max(0.02, 1 - yy.mean())).astype(np.float32)
    learnt = np.flatnonzero(own & (words.counts > 0))
    for epoch in range(warm_up):
        for b in np.array_split(rng.permutation(learnt), -(-len(learnt) // 64) or 1):
            if len(b):
                follow(_step_of_texts(p, words, b, y[b].astype(np.float32), weight_of(y[b]))[1], rate * (1 - 0.8 * epoch / warm_up))
    score = np.append(embedded(p, words) @ p["q"], np.float32(-1e9))
    warm = score[np.append(words.of, -1)[place]].max(axis=1)
    many = np.bincount(text)[text]
    limit = np.where(y[text] == 1, np.maximum(1, many // 4), many)

    def logits_of(rows: np.ndarray) -> np.ndarray:
        gates = net.gates(words)
        out = np.full(len(place), -1e9, np.float32)
        for i in range(0, len(rows), 2048):
            out[rows[i : i + 2048]] = net.logits(gates, np.append(words.of, -1)[place[rows[i : i + 2048]]])
        return out

    for epoch in range(epochs):
        logit = logits_of(np.flatnonzero(y[text] == 1)) if epoch >= 2 else warm
        rank = np.lexsort((-logit, text))
        nth_best = np.empty(len(text), int)
        nth_best[rank] = np.arange(len(text)) - np.searchsorted(text, text)
        rows = rng.permutation(np.flatnonzero(own[text] & (nth_best < limit)))
        for b in np.array_split(rows, -(-len(rows) // batch) or 1):
            if len(b):
                shown = np.where(rng.random(place[b].shape) < drop, -1, place[b])
                follow(_step(p, words, shown, y[text[b]].astype(np.float32), weight_of(y[text[b]]))[1], rate * (1 - 0.8 * epoch / epochs), 0.05)
    best = np.full(len(texts), -1e9)
    np.maximum.at(best, text, logits_of(np.arange(len(text))))
    slope, shift = _calibrated(best[~own], y[~own])
    if rate_of_toxic:
        odds = lambda q: np.log(q / (1 - q))
        shift += 0.5 * float(odds(np.clip(rate_of_toxic, 1e-4, 0.9)) - odds(np.clip(y.mean(), 1e-4, 1 - 1e-4)))
    return Network(p, slope, shift)


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number with a light ridge, by Newton's steps."""
    scale = max(1e-3, float(np.abs(x).max()))
    design = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        q = _sigmoid(design @ w)
        grad = design.T @ (q - y) + 0.05 * w
        hess = (design * (q * (1 - q))[:, None]).T @ design + 0.05 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(w[0] / scale), float(w[1])


def score_texts(texts: list[str | None], net: Network, chars: int = 1_000_000) -> np.ndarray:
    """A text's score: the calibrated chance of its highest window."""
    best = np.full(len(texts), -np.inf)
    for at, end in parts_of(texts, chars):
        words = inputs(texts[at:end])
        gates, of = net.gates(words), np.append(words.of, -1)
        place, text = windows(words.counts)
        for i in range(0, len(place), 2048):
            np.maximum.at(best, text[i : i + 2048] + at, net.logits(gates, of[place[i : i + 2048]]))
    return _sigmoid(net.slope * best + net.shift)


def _scores(doc_id: list, text: list, net) -> dict:
    if net is None:
        return {"doc_id": doc_id, "score": [0.0] * len(text)}
    return {"doc_id": doc_id, "score": score_texts(text, net.value).astype(float)}


def sample(docs: DataFrame, labels: DataFrame, each: int = 1000) -> DataFrame:
    """The training sample (text, y): of each class at most `each` labelled rows outside the held-out
    fold, least by hash, with their whole texts. Where a doc_id has several texts, the least of them stands for it. The number of rows does
    not grow with the data."""
    y = labels.where("doc_id is not null and toxic in (0, 1)").where(~training_fold(3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    some = None
    for c in (0, 1):
        part = y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        some = part if some is None else some.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, **kw) -> Network | None:
    """None where the sample lacks one of the classes."""
    rows = sorted(sample(docs, labels, **kw).collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    rate = labels.where(~training_fold(3, 1)).agg(F.avg(F.col("toxic").cast("double")).alias("r")).first()["r"]
    return train([r["text"] or "" for r in rows], y, rate_of_toxic=rate or 0.0)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, from all windows of its whole text; other columns are not read.

    Labels, lang, source and doc_id are no inputs. A text without words has one empty window and
    its score; rows without doc_id are scored and not held out. Without labels of both kinds
    every score is 0. Repeated rows stay; empty tables give no rows. The network is broadcast: about 1 MB, whatever the data.
    """
    net = fit(docs, labels)
    net = docs.sparkSession.sparkContext.broadcast(net) if net else None
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = map_columns(rows, _scores, "doc_id bigint, score double", rows=256, net=net)
    return out.select("doc_id", training_fold(3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
