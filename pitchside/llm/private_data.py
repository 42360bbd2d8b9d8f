"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, scheme marks, identifier
cue words) in one pass over the text; small deterministic parsers expand each anchor to the left
and right and validate what they get. Every parser works in time linear in what it reads, so long
runs of digits or letters cost no more than their length.

Base kinds: email, ip, card, phone, leftmost and non-overlapping within a kind. Added kinds: url
(scheme and host), account (a number after a cue such as IBAN or account; IBANs must pass their
check sum) and secret (the value given to a token, key or password). Spans of different kinds may
overlap. Offsets are code points, end exclusive.

Null and empty texts have no spans. Each input row gives one output row: repeated rows repeat;
a null doc_id stays null. Only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pitchside.llm.common import map_arrow, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account", "secret")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST_OF_URL = re.compile(r"[A-Za-z0-9\[][^\s<>\"'`{}|\\^]*")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,30}\Z")
_NUMBER = re.compile(
    r"(?:[\x20\t]{0,3}(?:number|num|nr|no)\b\.?)?[\x20\t]{0,3}[#:=]?[\x20\t]{0,3}"
    r"([A-Za-z]{0,2}[0-9](?:[\x20-]?[A-Z0-9]){4,33})(?![A-Za-z0-9])"
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
_VALUE = re.compile(r"[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?([^\s\"',;]{6,})")
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey")
_ACCOUNT_CUES = ("iban", "account", "acct", "konto", "ssn", "passport")


@cache
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    for word, what in (("@", "at"), ("+", "plus"), ("://", "url")):
        a.add_word(word, (what, len(word)))
    for words, what in ((_SECRET_CUES, "secret"), (_ACCOUNT_CUES, "account")):
        for w in words:
            a.add_word(w, (what, len(w)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _ip_ok(part: str) -> bool:
    part = part.lstrip("0") if len(part) > 3 else part
    return len(part) <= 3 and int(part or 0) <= 255


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lower-cased
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    resume = dict.fromkeys(KINDS, 0)
    for last, (what, n) in _anchors().iter(low):
        i = last - n + 1
        if what == "digit":
            if i >= resume["ip"] and (i == 0 or not "0" <= text[i - 1] <= "9"):
                if m := _IP.match(text, i):
                    resume["ip"] = m.end()
                    if all(map(_ip_ok, m[0].split("."))):
                        out["ip"].append(m.span())
            if i >= resume["card"] and (m := _CARD.match(text, i)):
                resume["card"] = m.end()
                if 16 <= m.end() - i <= 37:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        out["card"].append(m.span())
        elif what == "at":
            start = i
            while start > resume["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < i and (m := _DOMAIN.match(text, i + 1)):
                resume["email"] = m.end()
                out["email"].append((start, m.end()))
        elif what == "plus":
            if i >= resume["phone"] and (m := _PHONE.match(text, i)):
                resume["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif what == "url":
            s = _SCHEME.search(text, max(resume["url"], i - 31), i)
            if s and (m := _REST_OF_URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]*"))
                if end > last + 1:
                    out["url"].append((s.start(), end))
                    resume["url"] = end
        elif i == 0 or not text[i - 1].isalpha():  # a cue is no part of a longer word
            if what == "secret" and last + 1 >= resume["secret"]:
                if m := _VALUE.match(text, last + 1):
                    out["secret"].append(m.span(1))
                    resume["secret"] = m.end(1)
            elif what == "account" and last + 1 >= resume["account"]:
                if m := _NUMBER.match(text, last + 1):
                    bare = m[1].replace(" ", "").replace("-", "")
                    if sum("0" <= c <= "9" for c in bare) >= 5 and (
                        not _IBAN.match(bare) or _iban_ok(bare)
                    ):
                        out["account"].append(m.span(1))
                        resume["account"] = m.end(1)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    """kind:start:end of all spans, by kind and start, with commas between."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redacted(text: str | None) -> str | None:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    if not text:
        return text
    found = sorted((a, -b, k) for k, v in find_spans(text).items() for a, b in v)
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, -b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, the digest of the base spans, all spans, and their number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for text in batch.column(1).to_pylist():
            found = find_spans(text)
            counts.append([len(found[k]) for k in KINDS])
            digests.append(hashlib.sha256(joined(found, BASE).encode()).hexdigest())
            spans.append(joined(found))
        each = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *each, pa.array(digests), pa.array(spans), pa.array([sum(c) for c in counts], pa.int64())],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"],
        )

    return map_arrow(
        docs.selectExpr("cast(doc_id as bigint) doc_id", "text"),
        run,
        "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long",
    )


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with personal data replaced by its kind."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [redacted(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"]
        )

    return map_arrow(
        docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, text string"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii_anchors": op3}
