"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in whole texts: at-signs, URL schemes,
digits beside digits, dots between digits, a plus before a digit, and cue words
of account numbers. Local parsers expand each anchor to the left and right by
character classes and validate what they find. Texts without an anchor cost one
scan of the automaton and nothing else.

Base kinds: ``email``, ``ip``, ``card`` (Luhn), ``phone``. Kinds that the method
adds: ``login`` (user and password in a URL) and ``account`` (a number of 6 to 34
characters after a cue word, or a valid IBAN after its cue). Offsets are code
points, the end exclusive.

Rows: null and empty texts have no spans; a null document id stays null;
repeated rows repeat; extra columns are ignored; an empty table gives an empty
result; memory is one text and its spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

KINDS = ["email", "ip", "card", "phone", "login", "account"]
BASE = 4
CUES = ["account", "acct", "iban", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USERINFO = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@")
NUMBER = re.compile(r"[\s:#.=]{0,3}(?:(?:no|nr|number|n°)[\s:#.=]{1,3})?([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,33})",
                    re.IGNORECASE | re.ASCII)

Span = tuple[int, int, int]


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    digits = "0123456789"

    def add(word: str, what: str, back: int) -> None:
        found.add_word(word, (what, back))

    add("@", "email", 0)
    add("://", "login", -1)
    for a in digits:
        add(f"+{a}", "phone", 1)
        for b in digits:
            add(f"{a}.{b}", "ip", 2)
            for gap in ("", " ", "-"):
                add(f"{a}{gap}{b}", "card", 1 + len(gap))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            add(form, "account", -1)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    start = at
    while start > done and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def _account(text: str, after: int) -> tuple[int, int] | None:
    m = NUMBER.match(text, after)
    if not m:
        return None
    value = m[1].replace(" ", "").replace("-", "")
    if value[0].isalpha():
        # The longest head that is a valid IBAN; what follows is another word.
        for size in range(min(len(value), 34), 14, -1):
            if iban(value[:size].upper()):
                end, seen = m.start(1), 0
                while seen < size:
                    seen += text[end] not in " -"
                    end += 1
                return m.start(1), end
        return None
    return m.start(1), m.end(1)


def _start_of(text: str, at: int, done: int, dots: bool) -> int:
    """Left end of the run of digits (joined by dots, or by single spaces and hyphens) that holds ``at``."""
    joints = "." if dots else " -"
    while at > done:
        c = text[at - 1]
        if c.isascii() and c.isdigit():
            at -= 1
        elif c in joints and at - 1 > done and text[at - 2].isascii() and text[at - 2].isdigit():
            at -= 2
        else:
            break
    return at


def spans(text: str | None) -> list[Span]:
    """``(start, kind number, end)`` in order."""
    out: list[Span] = []
    if not text:
        return out
    done = dict.fromkeys(KINDS, 0)
    for end, (what, back) in automaton().iter(text):
        if what == "email":
            found = _email(text, end, done["email"])
            if found:
                out.append((found[0], 0, found[1]))
                done["email"] = found[1]
        elif what == "ip":
            at = end - back
            if at < done["ip"]:
                continue
            m = CHAIN.match(text, _start_of(text, at, done["ip"], True))
            place, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i: i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in four)):
                    out.append((place, 1, place + size))
                place += size + 1
            done["ip"] = m.end()
        elif what == "card":
            at = end - back
            if at < done["card"]:
                continue
            m = DIGITS.match(text, _start_of(text, at, done["card"], False))
            number = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(number) <= 19 and luhn(number):
                out.append((m.start(), 2, m.end()))
            done["card"] = m.end()
        elif what == "phone":
            at = end - back
            if at < done["phone"]:
                continue
            m = PHONE.match(text, at)
            if m:
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((at, 3, m.end()))
                done["phone"] = m.end()
        elif what == "login":
            m = USERINFO.match(text, end + 1)
            if m:
                out.append((end + 1, 4, m.end() - 1))
        elif end + 1 > done["account"]:
            found = _account(text, end + 1)
            if found and found[0] >= done["account"]:
                out.append((found[0], 5, found[1]))
                done["account"] = found[1]
    out.sort()
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: one row per input row; ``found`` has the spans as ``kind, start, end`` in order."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(span))])

    def build(ids: list, texts: list) -> tuple[list, list]:
        return ids, [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_rows(batches, build, schema)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")
