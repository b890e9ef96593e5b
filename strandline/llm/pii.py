"""Personal data by anchor expansion.

One Aho-Corasick pass over each whole text finds anchors: at-signs, schemes,
digits, plus signs before digits and cues that precede identifiers.  From an
anchor a small deterministic parser finds both boundaries and validates what lies
between.  Base kinds, in order of report: email, ip, card, phone; each kind is
matched leftmost, without overlap, and a match that fails its check is passed
over as a whole.  Added kinds: login (user and password in an address with a
scheme), secret (a value after a cue such as token, password, api_key, or a key
with a known head), iban (checked modulo 97), ssn (after its cue), and what a failed
match may hide: account (a card number among other groups of digits) and tel (a
grouped phone number with other digits after it).  An added span never lies inside
a base span and never changes one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import sha256
from .text import find_package, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "secret", "iban", "ssn", "account", "tel")
#: Cues in lower case, and heads of well-known keys as they are written.
CUES = {"token": "secret", "password": "secret", "passwd": "secret", "secret": "secret", "api_key": "secret", "api-key": "secret", "apikey": "secret", "access_key": "secret", "bearer": "secret", "iban": "iban", "ssn": "ssn", "social security": "ssn"}
HEADS = {"AKIA": 20, "ghp_": 40, "gho_": 40, "xoxb-": 24, "xoxp-": 24, "sk_live_": 24, "AIza": 39}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
GROUPED = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2}(?![0-9])")
GROUP = re.compile(r"[0-9]+")
LOGIN = re.compile(r"[^\s/?#@]+@")
VALUE = re.compile(r"[\"']?(?:\s{0,2}[:=]\s{0,2}|\s{1,2})[\"']?([A-Za-z0-9_\-+/=.~]{12,})")
KEY = re.compile(r"[A-Za-z0-9_-]+")
IBAN = re.compile(r"[\s:=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
SSN = re.compile(r"[^0-9\n]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def iban_end(text: str, start: int, end: int) -> int:
    """Where the longest valid account number of at most text[start:end] ends; -1 if none does."""
    for stop in range(end, start + 14, -1):
        plain = text[start:stop].replace(" ", "")
        if text[stop - 1] != " " and 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return stop
    return -1


def accounts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Card numbers among the groups of a run of digits: neighbouring groups of four or more digits, 13 to 19 in all, that pass the check."""
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    out, i = [], 0
    while i < len(groups):
        digits, j = "", i
        while j < len(groups) and groups[j][1] - groups[j][0] >= 4 and len(digits) + groups[j][1] - groups[j][0] <= 19:
            digits += text[slice(*groups[j])]
            j += 1
            if len(digits) >= 13 and luhn(digits):
                out.append((groups[i][0], groups[j - 1][1]))
                i = j - 1
                break
        i += 1
    return out


@lru_cache(1)
def automaton():
    """Once for each Python worker: anchors and what to do at each."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for d in DIGITS:
        auto.add_word(d, ("digit", 1))
        auto.add_word("+" + d, ("plus", 2))
    auto.add_word("@", ("at", 1))
    auto.add_word("://", ("scheme", 3))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            auto.add_word(form, (kind, len(form)))
    for head in HEADS:
        auto.add_word(head, ("key", len(head)))
    auto.make_automaton()
    return auto


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of KINDS, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(BASE, 0)  # where the last match of each kind ended, passed or not
    run_end = value_end = key_end = key_digit = 0  # where runs that were looked at end: what begins inside one is not read again
    for last, (anchor, size) in automaton().iter(text):
        at = last - size + 1
        if anchor in ("digit", "plus"):
            if anchor == "plus":
                if at >= end["phone"] and (m := PHONE.match(text, at)):
                    end["phone"] = m.end()
                    if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                        out["phone"].append(m.span())
                    elif (m := GROUPED.match(text, at)) and 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                        out["tel"].append(m.span())
                continue
            if at >= run_end:  # the first digit of a run: the one place in it where an address could start
                if at >= end["ip"] and (m := ADDRESS.match(text, at)):
                    end["ip"] = m.end()
                    if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in m.groups()) and all(int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        out["ip"].append(m.span())
                run_end = at + 1
                while run_end < len(text) and text[run_end] in DIGITS:
                    run_end += 1
            if at >= end["card"] and (m := RUN.match(text, at)):
                end["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
                elif len(digits) > 13:
                    out["account"] += accounts(text, *m.span())
        elif anchor == "at":
            start, floor = at, end["email"]
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                end["email"] = m.end()
                out["email"].append((start, m.end()))
        elif anchor == "scheme":
            if (m := LOGIN.match(text, last + 1)) and ":" in m[0]:
                out["login"].append((m.start(), m.end() - 1))
        elif anchor == "secret":
            # A later cue inside a value has the same end: it is in the same secret, or there is no digit for either.
            if last >= value_end and (at == 0 or not text[at - 1].isalnum()) and (m := VALUE.match(text, last + 1)):
                value_end = m.end()
                if DIGIT.search(text, *m.span(1)):
                    out["secret"].append(m.span(1))
        elif anchor == "key":
            if at == 0 or not text[at - 1].isalnum():
                if at >= key_end:
                    key_end = KEY.match(text, at).end()
                    key_digit = max(text.rfind(d, at, key_end) for d in DIGITS)
                if key_end - at >= HEADS[text[at : last + 1]] and key_digit >= at:
                    out["secret"].append((at, key_end))
        elif anchor == "iban":
            if (m := IBAN.match(text, last + 1)) and (stop := iban_end(text, *m.span(1))) > 0:
                out["iban"].append((m.start(1), stop))
        elif anchor == "ssn" and (m := SSN.match(text, last + 1)):
            out["ssn"].append(m.span(1))
    base = sorted(s for k in BASE for s in out[k])
    begins, furthest = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    held = lambda a, b: (i := bisect_right(begins, a)) and furthest[i - 1] >= b
    for kind in KINDS[len(BASE) :]:
        mine, floor = [], 0
        for a, b in sorted(set(out[kind])):
            if a >= floor and not held(a, b):
                mine.append((a, b))
                floor = b
        out[kind] = mine
    return [(k, a, b) for k in KINDS for a, b in out[k]]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, names the whole."""
    parts, floor = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        parts += [text[floor:a], f"[{kind.upper()}]"]
        floor = b
    return "".join([*parts, text[floor:]])


def scan(documents: DataFrame, rewrite: bool = False) -> DataFrame:
    """The columns of `documents`, with `text` redacted if `rewrite`, and `spans` (array of kind, start, end).

    Only `text` is read; other columns pass through, but a column named spans is
    replaced.  Null and empty texts have no spans (a null text stays null).  Offsets
    are code points, ends exclusive.  One row comes out for each row that goes in.
    """
    find_package(documents.sparkSession)
    source = documents.drop("spans")
    at = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            found = [find(t) if t else [] for t in texts]
            if rewrite:
                columns[at] = pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], SPANS))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "spans"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema]
    return source.mapInArrow(run, ", ".join([*fields, "spans array<struct<kind:string,start:bigint,end:bigint>>"]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(count, BASE), sha256(joined(F.filter("spans", lambda s: s.kind.isin(*BASE)))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
