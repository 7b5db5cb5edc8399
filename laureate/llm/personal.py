"""Personal data by anchors: an Aho-Corasick automaton finds at-signs, digits, schemes and cues, and a small parser at each
anchor finds where an address or identifier begins and ends and whether it is one."""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Kinds in the order of `spans`: the four of the base rules, then the operator's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailbox", "login", "account", "secret")

#: Words before an identifier of a person, and before a secret.
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "social security", "passport", "tax id", "driver license", "member id", "customer id", "patient id", "user id")
SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "token", "secret", "api_key", "apikey", "api key", "access_key", "private_key", "client_secret")
#: How keys of well-known issuers begin, with what follows.
KEY_PREFIXES = {"AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "AIza": r"[A-Za-z0-9_-]{35}", "ghp_": r"[A-Za-z0-9]{36}", "sk_live_": r"[A-Za-z0-9]{16,}+"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
_DIGIT_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]*+")
_WIDE_DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]++)++")
_AUTHORITY = re.compile(r"[^\s/?#@<>\"']++@(?:\[[0-9A-Fa-f:.]++\]|[\w.-]++)(?::[0-9]++)?+")
_ASSIGNED = re.compile(r"[\"']?+[ \t]*+[:=][ \t]*+")
_QUOTED = re.compile(r"\"[^\"\n]{4,}+\"|'[^'\n]{4,}+'")
_BARE = re.compile(r"[^\s\"'<>,;]{8,}+")
_NUMBERED = re.compile(r"(?:[ \t]*+(?:number|num|no\.?|nr\.?|id|is|#|:|=))*+[ \t]*+", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}+")
_NUMBER = re.compile(r"[A-Z]{0,3}+[0-9](?:-?[0-9]){5,19}+(?![A-Za-z0-9])")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _iban(text: str) -> int:
    """Length of the longest account number, in whole groups, that its check digits confirm modulo 97; 0 if there is none."""
    while len(s := text.replace(" ", "")) >= 15:
        if len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return len(text)
        if " " not in text:
            break
        text = text.rpartition(" ")[0]
    return 0


def _first(text: str, at: int, least: int, member) -> int:
    """Where the run of members before `at` begins, `least` at the earliest."""
    while at > least and member(text[at - 1]):
        at -= 1
    return at


class Scan:
    """Spans (kind, start, end) of one text. Every parser starts at an anchor and ends behind what it took, so that a
    character is looked at a bounded number of times however long the text is."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        self.behind = dict.fromkeys(("email", "ip", "card", "mailbox", "login", "account", "secret"), 0)
        self.dull = 0

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans[kind].append((start, end))

    def at_sign(self, at: int) -> None:
        text = self.text
        start = _first(text, at, self.behind["email"], _LOCAL.__contains__)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            self.add("email", start, domain.end())
            self.behind["email"] = domain.end()
        # Letters of any alphabet: an address that the plain form misses or cuts.
        wide = _first(text, at, self.behind["mailbox"], lambda c: c.isalnum() or c in "._%+-")
        rest = _WIDE_DOMAIN.match(text, at + 1) if wide < at else None
        if rest:
            self.behind["mailbox"] = rest.end()
            end = rest.end()
            while text[end - 1] in "-_":
                end -= 1
            if not text[wide:end].isascii() and (not domain or (wide, end) != (start, domain.end())):
                self.add("mailbox", wide, end)

    def digit(self, at: int) -> None:
        text = self.text
        if at >= self.behind["ip"]:
            chain = _CHAIN.match(text, at)
            parts = chain.group().split(".")
            self.behind["ip"] = chain.end()
            if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                self.add("ip", at, chain.end())
        if at >= self.behind["card"]:
            run = _DIGIT_RUN.match(text, at)
            self.behind["card"] = run.end()
            if 16 <= run.end() - at <= 37:
                digits = run.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    self.add("card", at, run.end())

    def plus(self, at: int) -> None:
        run = _PHONE_RUN.match(self.text, at)
        if run:
            taken = run.group().rstrip(" ().-")
            if len(taken) > 3 and 8 <= sum(map(taken.count, "0123456789")) <= 15:
                self.add("phone", at, at + len(taken))

    def scheme(self, at: int) -> None:
        """`name://user@host`: a web address that names who logs in. at: its colon."""
        start = _first(self.text, at, max(self.behind["login"], at - 20), lambda c: c.isascii() and (c.isalnum() or c in "+.-"))
        found = _AUTHORITY.match(self.text, at + 3) if start < at else None
        if found:
            self.behind["login"] = found.end()
            self.add("login", start, found.end())

    def _alone(self, start: int) -> bool:
        return start == 0 or not self.text[start - 1].isalnum()

    def account(self, start: int, end: int) -> None:
        """An identifier behind a cue: an account number by its check digits, or six digits and more."""
        if start < self.behind["account"] or not self._alone(start) or (end < len(self.text) and self.text[end].isalnum()):
            return
        at = _NUMBERED.match(self.text, end).end()
        bank, number = _IBAN.match(self.text, at), _NUMBER.match(self.text, at)
        size = (bank and _iban(bank.group())) or (number and len(number.group()))
        if size:
            self.behind["account"] = at + size
            self.add("account", at, at + size)

    def secret(self, start: int, end: int) -> None:
        """A value given to a cue by `=` or `:`, together with the cue: quoted, or at least eight characters with a digit and a letter."""
        if start < self.behind["secret"] or not self._alone(start):
            return
        given = _ASSIGNED.match(self.text, end)
        if given and given.end() < self.dull:
            return  # within a value that was none
        value = given and (_QUOTED.match(self.text, given.end()) or _BARE.match(self.text, given.end()))
        if not value:
            return
        body = value.group().strip("\"'").rstrip(".)]}:!?")
        if len(body) >= 8 and any(c.isdigit() for c in body) and any(c.isalpha() for c in body):
            stop = value.end() if value.group()[0] in "\"'" else value.start() + len(body)
            self.behind["secret"] = stop
            self.add("secret", start, stop)
        else:
            self.dull = value.end()

    def key(self, start: int, rest: re.Pattern) -> None:
        found = rest.match(self.text, start)
        if found and start >= self.behind["secret"] and self._alone(start) and not self.text[found.end() : found.end() + 1].isalnum():
            self.behind["secret"] = found.end()
            self.add("secret", start, found.end())


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    """All anchors. Cues in small, capital and title letters."""
    made = ahocorasick.Automaton()
    for c in "0123456789":
        made.add_word(c, ("digit", 1, None))
    for word, what in (("@", "at_sign"), ("+", "plus"), ("://", "scheme")):
        made.add_word(word, (what, len(word), None))
    for what, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                made.add_word(form, (what, len(form), None))
    for prefix, rest in KEY_PREFIXES.items():
        made.add_word(prefix, ("key", len(prefix), re.compile(re.escape(prefix) + rest)))
    made.make_automaton()
    return made


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive, by start; null and empty texts have none."""
    scan = Scan(text or "")
    if not text:
        return scan.spans
    for last, (what, size, rest) in _automaton().iter(text):
        start = last + 1 - size
        if what == "digit":
            if start >= scan.behind["ip"] or start >= scan.behind["card"]:
                scan.digit(start)
        elif what == "key":
            scan.key(start, rest)
        elif what in ("account", "secret"):
            getattr(scan, what)(start, last + 1)
        else:
            getattr(scan, what)(start)
    for found in scan.spans.values():
        found.sort()
    return scan.spans


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def _report(doc_id: list, text: list) -> dict:
    rows = [spans(t) for t in text]
    out: dict = {"doc_id": doc_id} | {f"n_{k}": [len(r[k]) for r in rows] for k in BASE}
    out["base_sha256"] = [hashlib.sha256(_joined(r, BASE).encode()).hexdigest() for r in rows]
    out["spans"] = [_joined(r, KINDS) for r in rows]
    return out


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row of docs, over whole texts.

    spans lists kind:start:end of every find, in code points, by kind (KINDS) and start. Beside the base rules: mailboxes with letters beyond ASCII,
    logins in web addresses, account numbers behind a cue, secrets given to a cue or known by their prefix. Spans of different
    kinds may overlap. Null and empty texts have none; null and repeated doc_ids stay as rows; other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_columns(rows, _report, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with every find in the text replaced by its kind in angle brackets (overlapping finds by the first one's); all other
    columns stay, of any names."""
    at = docs.columns.index(text)
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.set_column(at, part.schema.field(at), pa.array(map(_mask, part.column(at).to_pylist()), part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _mask(text: str | None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, found in spans(text).items() for a, b in found):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])
