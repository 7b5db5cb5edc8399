"""Quality rules by repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, segments
from .suffix_dedup import Rolling, _mix

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
#: Bytes that do not begin a character of a word.
_NOT_COUNTED = bytes(_SPACES) + bytes(range(0x80, 0xC0))

#: Most that may lie in repeats after the first occurrence, by words of the n-gram (share of characters
#: in words); and in lines equal to an earlier one.
LIMITS = {5: 0.35, 8: 0.30, 12: 0.28}
LINE_LIMIT = 0.40


def _window_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all runs of n words, from the words' hashes."""
    out = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + word[i : i + len(out)]
    return _mix(out)


def _repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Booleans: the hash occurs twice or more; it occurred earlier."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    later, found = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return found, later


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    step = np.zeros(size + 1, np.int32)
    step[:-1][np.flatnonzero(starts)] += 1
    at = np.flatnonzero(starts) + n
    np.add.at(step, at, -1)
    return np.cumsum(step[:-1]) > 0


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of characters of each word of a text, made of a part of it at a time."""
    hashes, sizes = [], []
    for part in segments(data):
        b = np.frombuffer(part, np.uint8)
        space = np.concatenate([[True], np.isin(b, _SPACES), [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[::2], edge[1::2]
        first = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80, dtype=np.int32)])
        hashes.append(Rolling(part).of(start, end) + (end - start).astype(np.uint64))
        sizes.append(first[end] - first[start])
    return (np.concatenate(hashes), np.concatenate(sizes)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def measure(text: str | None) -> dict:
    """Counts of one whole text (null: empty), with the shares of characters in repeats."""
    data = (text or "").encode("utf-8", "replace")
    word, chars = _words(data)
    n_words, word_chars = len(word), int(chars.sum())
    n_symbols = len(data) - len(data.translate(None, bytes(_SYMBOLS)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    dup_lines, dup_line_chars = 0, 0
    if len(set(lines)) < len(lines):
        for x in lines:
            if x in seen:
                dup_lines += 1
                dup_line_chars += len(x.translate(None, _NOT_COUNTED))
            seen.add(x)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": 0}
    worst = dup_line_chars / max(1, word_chars) / LINE_LIMIT
    for n, limit in LIMITS.items():
        if n_words < n:
            break
        found, later = _repeats(_window_hashes(word, n))
        if not later.any():
            break  # no longer run repeats either
        worst = max(worst, int(chars[_covered(later, n, n_words)].sum()) / word_chars / limit)
        if n == 8:
            out["n_repeat_words"] = int(_covered(found, n, n_words).sum())
    out["worst"] = worst
    return out


def _judge(doc_id: list, text: list) -> dict:
    rows = [measure(t) for t in text]
    out = {"doc_id": doc_id} | {c: [r[c] for r in rows] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out["base_failed"] = [r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"] for r in rows]
    out["repetition"] = [r["worst"] for r in rows]
    out["kept"] = [not f and r["worst"] <= 1 for f, r in zip(out["base_failed"], rows, strict=True)]
    return out


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, repetition (largest share of repeated characters by its limit; over 1 fails), kept.

    Null and empty texts have no words and fail the base rule. Null doc_ids and repeated rows
    stay as rows; other columns are not read. Empty tables give no rows. A text's memory is a few times its size; no text is cut.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_columns(rows, _judge, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, repetition double, kept boolean")
