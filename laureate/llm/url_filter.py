"""URL filters: many glob rules at once by multiword Shift-And."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """`example.org/es/`: host up to the first slash, path from it on."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


class Automaton:
    """Glob patterns (`*` any run of bytes) packed into 64-bit words of one state.

    A bit stands for a prefix of a pattern; a byte shifts the bits whose next symbol it is,
    a star keeps its bit alive. All patterns and a whole batch of strings move together,
    one byte position at a time.
    """

    def __init__(self, patterns: Sequence[str]):
        symbols: list[tuple[int | None, bool]] = []  # byte that leads here; a star stands behind it
        self.first, self.last = [], []
        for p in patterns:
            data = p.encode()
            self.first.append(len(symbols))
            symbols.append((None, data[:1] == b"*"))
            i = 0
            while i < len(data):
                if data[i : i + 1] != b"*":
                    symbols.append((data[i], data[i + 1 : i + 2] == b"*"))
                i += 1
            self.last.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept = np.zeros(self.words, np.uint64)
        begin, end = set(self.first), set(self.last)
        for i, (b, star) in enumerate(symbols):
            w, bit = i // 64, np.uint64(1 << i % 64)
            if b is not None:
                self.step[b, w] |= bit
            if star:
                self.stay[w] |= bit
            if i in begin:
                self.start[w] |= bit
            if i in end:
                self.accept[w] |= bit
        self.of = {i: j for j, i in enumerate(self.last)}  # pattern by its last bit
        self.numbers: tuple[list[int], int] | None = None

    def _on(self, state: np.ndarray, data: bytes) -> np.ndarray:
        """The state after further bytes, in whole numbers instead of arrays: for a string that goes on when few others do."""
        if self.numbers is None:
            self.numbers = [int.from_bytes(w.tobytes(), "little") for w in self.step], int.from_bytes(self.stay.tobytes(), "little")
        step, stay = self.numbers
        now = int.from_bytes(state.tobytes(), "little")
        for b in data:
            now = ((now << 1) & step[b]) | (now & stay)
        return np.frombuffer(now.to_bytes(8 * self.words, "little"), np.uint64)

    def hits(self, strings: Sequence[bytes], few: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(string, pattern) of every pattern that a whole string fits. Memory: one state for each string, and the hits.
        Once `few` strings or fewer go on, each is finished by itself (_on)."""
        n = len(strings)
        size = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-size, kind="stable")
        state = np.tile(self.start, (n, 1))
        longest_first = [strings[i] for i in order]
        sizes = size[order]
        together = int(sizes[few]) if n > few else 0  # bytes of all that are read side by side
        flat = np.frombuffer(b"".join(s[:together] for s in longest_first), np.uint8)
        short = np.minimum(sizes, together)
        at = np.concatenate([[0], np.cumsum(short)[:-1]]) if n else np.zeros(0, np.int64)
        for pos in range(together):
            live = int(np.searchsorted(-sizes, -pos, side="left"))
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[flat[at[:live] + pos]]) | (now & self.stay)
        for i in range(min(n, few)):
            if sizes[i] > together:
                state[i] = self._on(state[i], longest_first[i][together:])
        state &= self.accept
        rows, words = np.nonzero(state)
        found_rows, found = [], []
        for r, w in zip(rows.tolist(), words.tolist(), strict=True):
            left = int(state[r, w])
            while left:
                low = left & -left
                found_rows.append(order[r])
                found.append(self.of[64 * w + low.bit_length() - 1])
                left ^= low
        return np.array(found_rows, np.int64), np.array(found, np.int64)

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """The same as booleans, a row for each string and a column for each pattern."""
        out = np.zeros((len(strings), len(self.last)), bool)
        out[self.hits(strings)] = True
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host (after the first `://` up to `/`, `?`, `#`; A-Z lower-cased) and path (then up to
    `?` or `#`). Null, or no `://`: both empty."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].encode().lower().decode(), tail[:stop]


_AUTOMATA: dict[tuple, Automaton] = {}


def _judge(page_id: list, url: list, rules: tuple[Rule, ...], globs: tuple[str, ...], otherwise: str) -> dict:
    key = (rules, globs)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton([p for r in rules for p in (f"{r.host}\n{r.path}*", f"*.{r.host}\n{r.path}*")] + list(globs))
    parts = [canonical(u) for u in url]
    # A newline parts host and path, so that no rule's host reaches into a path.
    rows, found = _AUTOMATA[key].hits([f"{h}\n{p.replace(chr(10), ' ')}".encode() for h, p in parts])
    blocked = np.zeros(len(url), bool)
    blocked[rows[found >= 2 * len(rules)]] = True
    best = np.full(len(url), -1)
    length = np.array([len(r.text) for r in rules] or [0])
    fits = found < 2 * len(rules)
    rows, nth = rows[fits], found[fits] // 2
    # By length and, among equals, the first rule: what is written last holds.
    by = np.lexsort((-nth, length[nth]))
    best[rows[by]] = nth[by]
    return {
        "page_id": page_id, "host": [h for h, _ in parts], "path": [p for _, p in parts],
        "rule": [rules[b].text if b >= 0 else None for b in best],
        "verdict": [rules[b].verdict if b >= 0 else "block" if x and h else otherwise for b, x, (h, _) in zip(best, blocked, parts, strict=True)],
    }


def judge_urls(pages: DataFrame, rules: Sequence[Rule], globs: Sequence[str] = (), otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    decides. Elsewhere `globs` over host, newline, path block, else `otherwise` holds. Null urls and
    urls without `://` have no host, fit no rule and no glob. Repeated rows and null ids stay.
    Empty tables give no rows. Only page_id and url are read, whatever the other columns' names. The rules are a parameter, packed once per process in
    time linear in their size; a url of any length is judged whole, about a second for some megabytes.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"))
    return map_columns(rows, _judge, "page_id bigint, host string, path string, rule string, verdict string", rows=4096, rules=tuple(rules), globs=tuple(globs), otherwise=otherwise)
