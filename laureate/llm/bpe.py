"""Byte-level BPE: DuckDB recursive queries inside Spark tasks.

A text is split by the vocabulary's pattern; each distinct piece is encoded by a recursive query over
token-position rows, which contracts the leftmost pair of least rank until none is left, and a task
process remembers it. Decoding is a join to the vocabulary and an ordered aggregate.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Pieces of one generation of a task process's memory; it holds two, and the older one goes. Speed only.
REMEMBERED = 250_000

#: Bytes of a part of a longer piece: see Codec.contract_long.
PART = 256

#: A word is a row of ids. Each round unnests the pairs of neighbours with their position,
#: joins the merge table, and contracts the least (rank, position); words without a pair stop.
_ENCODE = """
WITH RECURSIVE t(w, ids, live) AS (
  SELECT w, ids, true FROM start_words
  UNION ALL
  SELECT t.w,
         CASE WHEN k IS NULL THEN ids ELSE ids[:(k % 4294967296)] || [(k // 4294967296)::INT] || ids[(k % 4294967296) + 3:] END,
         k IS NOT NULL
  FROM t LEFT JOIN (
    SELECT w, min(m.r::BIGINT * 4294967296 + p) AS k
    FROM (SELECT w, unnest(ids) AS a, unnest(ids[2:]) AS b, unnest(range(len(ids) - 1)) AS p FROM t WHERE live) n
    JOIN merges m USING (a, b) GROUP BY w) best USING (w)
  WHERE live
)
SELECT w, ids FROM t WHERE NOT live ORDER BY w
"""

#: Ordered aggregation: the rows of a sequence come sorted by position.
_DECODE = """
SELECT w, unhex(string_agg(h, '')) AS back
FROM (SELECT w, h FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM encoded) JOIN vocabulary USING (id) ORDER BY w, p)
GROUP BY w
"""


def ranks_of(data: bytes) -> dict[bytes, int]:
    """The entries of a rank file: base64 token, rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """One vocabulary in one process."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = ranks_of(data)
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        # Decimal ids of pieces, now and in the generation before; decoded bytes only where they differ from the piece.
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        pairs = [
            (a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None
        ]
        merges = pa.table(dict(zip("abr", (pa.array(c, pa.int32()) for c in zip(*pairs, strict=True)), strict=True))) if pairs else pa.table({c: pa.array([], pa.int32()) for c in "abr"})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "h": [t.hex() for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.size = np.zeros(max(self.ranks.values(), default=0) + 1, np.int64)
        self.size[list(self.ranks.values())] = [len(t) for t in self.ranks]

    def _rows(self, sizes: list[int], flat: np.ndarray) -> pa.Table:
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.table({"w": np.arange(len(sizes), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))})

    def _contract(self, raw: list[bytes]) -> None:
        """Fills the table `encoded` with the ids of each byte string, by merges alone."""
        start_words = self._rows([len(b) for b in raw], self.byte_id[np.frombuffer(b"".join(raw), np.uint8)])  # noqa: F841
        self.db.execute("CREATE OR REPLACE TEMP TABLE encoded AS " + _ENCODE)

    def contract(self, raw: list[bytes]) -> list[np.ndarray]:
        self._contract(raw)
        ids = self.db.sql("SELECT ids FROM encoded ORDER BY w").to_arrow_table()["ids"].combine_chunks()
        return np.split(ids.flatten().to_numpy(), ids.offsets.to_numpy()[1:-1]) if raw else []

    def contract_long(self, raw: bytes) -> np.ndarray:
        """The ids of a string of any length, in time that grows with it.

        Tokens are the string's own exactly if each two neighbours, encoded by themselves, stay those two: the first merge that
        crossed their border would come first among them as well. So parts are encoded, cut at a token's end near their
        middle, what lies between two cuts is encoded anew, and a cut whose neighbours would merge is given up.
        """
        parts = self.contract([raw[i : i + PART] for i in range(0, len(raw), PART)])
        cuts = [0]
        for i, ids in enumerate(parts):
            ends = np.cumsum(self.size[ids])
            cuts.append(i * PART + int(ends[np.abs(ends - PART // 2).argmin()]))
        cuts = sorted({*cuts, len(raw)})
        known: dict[tuple[int, int], np.ndarray] = {}
        while True:
            new = [x for x in zip(cuts, cuts[1:], strict=False) if x not in known]
            known |= zip(new, self.contract([raw[a:b] for a, b in new]), strict=True)
            spans = [known[x] for x in zip(cuts, cuts[1:], strict=False)]
            borders = [(int(x[-1]), int(y[0])) for x, y in zip(spans, spans[1:], strict=False)]
            text = {r: t for t, r in self.ranks.items() if r in {r for p in borders for r in p}}
            kept = [len(x) == 2 for x in self.contract([text[a] + text[b] for a, b in borders])]
            if all(kept):
                return np.concatenate(spans)
            cuts = [0, *(c for c, k in zip(cuts[1:-1], kept, strict=True) if k), len(raw)]

    def learn(self, pieces: list[str]) -> dict[str, str]:
        """Of each piece: its ids in decimal, joined by commas. Each is decoded as well; `odd` gets the bytes of those
        that do not come back as they were."""
        raw = [x.encode("utf-8", "surrogatepass") for x in pieces]
        # The library gives a piece that is in the vocabulary its own rank, without merges.
        alone = [(i, r) for i, b in enumerate(raw) if (r := self.ranks.get(b)) is not None]
        long = [] if self.byte_id.min() < 0 else [i for i, b in enumerate(raw) if len(b) > 2 * PART and b not in self.ranks]
        sure = [(i, np.array([r], np.int32)) for i, r in alone] + [(i, self.contract_long(raw[i])) for i in long]
        gone = {i for i, _ in sure}
        rest = [i for i in range(len(raw)) if i not in gone]
        self._contract([raw[i] for i in rest])
        if sure:
            sure_rows = self._rows([len(x) for _, x in sure], np.concatenate([x for _, x in sure]))  # noqa: F841
            self.db.execute(f"INSERT INTO encoded SELECT w + {len(rest)}, ids FROM sure_rows")
        got = self.db.sql(f"SELECT array_to_string(ids, ',') AS decimal, back FROM encoded LEFT JOIN ({_DECODE}) USING (w) ORDER BY w").to_arrow_table()
        order = rest + [i for i, _ in sure]
        backs = got["back"].combine_chunks()
        if b"".join(map(raw.__getitem__, order)) != b"".join(backs.to_pylist()) if backs.null_count == 0 else True:
            self.odd |= {pieces[i]: b or b"" for i, b in zip(order, backs.to_pylist(), strict=True) if b != raw[i]}
        return dict(zip(map(pieces.__getitem__, order), got["decimal"].to_pylist(), strict=True))

    def split(self, text: str) -> list[str]:
        return [m.group() for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)

    def encode(self, texts: list[str]) -> tuple[list[str], list[bytes]]:
        """Of each text: its ids in decimal, joined by commas, and the bytes that they decode to.

        Pieces are encoded and decoded once each; a text's are joined, as neither crosses a piece.
        """
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
            self.odd = {p: b for p, b in self.odd.items() if p in self.old}
        split = [self.split(t) for t in texts]
        fresh = set().union(*split).difference(self.young)
        again = fresh.intersection(self.old)
        self.young |= {p: self.old[p] for p in again} | self.learn(list(fresh - again))
        ids, odd = self.young.__getitem__, self.odd
        decimal = [",".join(map(ids, ps)) for ps in split]
        if odd:
            return decimal, [b"".join(b if (b := odd.get(p)) is not None else p.encode("utf-8", "surrogatepass") for p in ps) for ps in split]
        return decimal, ["".join(ps).encode("utf-8", "surrogatepass") for ps in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids; ids outside the vocabulary have none."""
        encoded_rows = self._rows([len(x) for x in ids], np.concatenate(ids) if ids else np.zeros(0, np.int32))  # noqa: F841
        self.db.execute("CREATE OR REPLACE TEMP TABLE encoded AS SELECT * FROM encoded_rows")
        out = [b""] * len(ids)
        for w, back in self.db.execute(_DECODE).fetchall():
            out[w] = back
        return out


_CODECS: dict[str, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(data).hexdigest() + pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def _grouped(texts: list[str], most: int = 4_000_000):
    """Slices of about `most` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _encode(doc_id: list, text: list, vocab, pattern: str, digest: bool) -> dict:
    c = codec(vocab.value, pattern)
    texts = [t or "" for t in text]
    out: dict[str, list] = {"doc_id": doc_id, "n_tokens": []} | ({"ids_sha256": [], "decoded_sha256": []} if digest else {"ids": []})
    for s, e in _grouped(texts):
        once = list(dict.fromkeys(texts[s:e]))  # copies of a text are often neighbours
        at = dict(zip(once, zip(*c.encode(once), strict=True), strict=True))
        decimal, back = zip(*map(at.__getitem__, texts[s:e]), strict=True)
        out["n_tokens"] += [x.count(",") + 1 if x else 0 for x in decimal]
        if digest:
            out["ids_sha256"] += [hashlib.sha256(x.encode()).hexdigest() for x in decimal]
            out["decoded_sha256"] += [hashlib.sha256(x).hexdigest() for x in back]
        else:
            out["ids"] += [np.fromstring(x, np.int32, sep=",") for x in decimal]
    return out


def _count(doc_id: list, source: list, lang: list, text: list, vocab, pattern: str) -> dict:
    return {"doc_id": doc_id, "source": source, "lang": lang, "n_tokens": _encode(doc_id, text, vocab, pattern, True)["n_tokens"]}


def _decode(doc_id: list, ids: list, vocab, pattern: str) -> dict:
    c = codec(vocab.value, pattern)
    return {"doc_id": doc_id, "decoded": c.decode([np.array([-1 if i is None else i for i in x or []], np.int32) for x in ids])}


def _vocabulary(docs: DataFrame, path: str):
    """Broadcast: a vocabulary file, about 1 MB whatever the data."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of each row; with digest, SHA-256 of the decimal ids
    and of the decoded bytes instead. Null texts are empty: no ids. Null doc_ids and repeated
    rows stay as rows; other columns are not read."""
    columns = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_columns(rows, _encode, f"doc_id bigint, n_tokens bigint, {columns}", rows=8192, vocab=_vocabulary(docs, path), pattern=pattern, digest=digest)


def counted(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of each row; null texts have no tokens. Other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("bigint"), *[F.col(c).cast("string") for c in ("source", "lang", "text")])
    return map_columns(rows, _count, "doc_id bigint, source string, lang string, n_tokens bigint", rows=8192, vocab=_vocabulary(docs, path), pattern=pattern)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of rows (doc_id, ids). Null ids decode to no bytes."""
    return map_columns(encoded.select("doc_id", "ids"), _decode, "doc_id bigint, decoded binary", vocab=_vocabulary(encoded, path), pattern=pattern)
