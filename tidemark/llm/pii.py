"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs, plus
signs, digits, URL schemes and identifier cues.  Each anchor starts a small local parser
that expands to the boundaries of an address and validates it; text without anchors is
never parsed.  Base kinds, leftmost and non-overlapping per kind:

* email: local part, at-sign, labels joined by dots (two at least);
* ip: four digit groups joined by dots, each at most 255;
* card: digits with single spaces or hyphens between them, 16 to 19, Luhn sum right;
* phone: a plus sign and 8 to 15 digits with spaces, dots, brackets or hyphens.

A match that fails its check is dropped and not tried again.  The method adds url
(scheme to the end of the address), account (a cue such as "iban" or "account" and the
number behind it, IBANs with their check digits) and secret (a cue such as "password"
or "token" and its value, and cloud key ids).

Offsets count code points, ends are exclusive.  Null and empty texts have no spans.
Repeated rows are answered each; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "www.")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
KEY_CUES = ("AKIA", "ASIA")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|\\^`{}]+")
_NUMBER = re.compile(r"[\s:#=.]{1,3}(?:(?:no|nr|number)[\s:#=.]{1,3})?([A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9]){5,33})")
_VALUE = re.compile(r"\s{0,2}[=:]\s{0,2}[\"']?([^\s\"']{6,})")
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def iban(text: str) -> bool:
    plain = re.sub(r"[ -]", "", text)
    return bool(_IBAN.fullmatch(plain)) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                found.add_word(form, (kind, len(form)))
    for w in KEY_CUES:
        found.add_word(w, ("key", len(w)))
    found.make_automaton()
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind in the order of ``KINDS``, then start."""
    out: list[tuple[str, int, int]] = []
    until = dict.fromkeys((*KINDS, "dotted", "digits"), 0)

    def take(kind: str, start: int, end: int) -> None:
        out.append((kind, start, end))
        until[kind] = end

    for last, (kind, width) in anchors().iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= until["dotted"]:
                chain = _DOTTED.match(text, at)
                until["dotted"] = chain.end()
                parts, pos = chain[0].split("."), at
                for k in range(0, len(parts) - 3, 4):
                    end = pos + sum(map(len, parts[k:k + 4])) + 3
                    if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts[k:k + 4]):
                        take("ip", pos, end)
                    pos = end + 1
            if at >= until["digits"]:
                chain = _DIGITS.match(text, at)
                until["digits"] = chain.end()
                if 16 <= chain.end() - at:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        take("card", at, chain.end())
        elif kind == "at":
            start, floor = at, until["email"]
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (domain := _DOMAIN.match(text, at + 1)):
                take("email", start, domain.end())
        elif kind == "plus":
            if at >= until["phone"] and (dial := _DIAL.match(text, at)):
                until["phone"] = dial.end()
                if 8 <= sum(c in "0123456789" for c in dial[0]) <= 15:
                    take("phone", at, dial.end())
        elif kind == "url":
            if at >= until["url"] and (rest := _URL.match(text, last + 1)):
                end = rest.end()
                while text[end - 1] in ".,;:!?)]":
                    end -= 1
                if end > last + 1 and "." in text[at:end]:
                    take("url", at, end)
        elif kind == "account":
            if at >= until["account"] and not text[at - 1:at].isalnum() and (number := _NUMBER.match(text, last + 1)):
                value = number[1]
                if iban(value) if value[0].isalpha() and value[1:2].isalpha() else sum(c.isdigit() for c in value) >= 6:
                    take("account", *number.span(1))
        elif kind == "secret":
            if at >= until["secret"] and (value := _VALUE.match(text, last + 1)):
                take("secret", *value.span(1))
        elif at >= until["secret"] and not text[at - 1:at].isalnum() and (rest := _KEY.match(text, last + 1)):
            take("secret", at, rest.end())
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (rank[s[0]], s[1]))


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one."""
    parts, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def marked(docs: DataFrame) -> DataFrame:
    """Per row doc_id, counts of the base kinds, hash of the base spans and all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(t) for t in texts_of(batch)]
        base = [[s for s in f if s[0] in BASE] for f in found]
        counts = [Counter(s[0] for s in f) for f in base]
        return pa.record_batch([batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in BASE),
                                pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base]), pa.array([_joined(f) for f in found])], names)
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return arrow_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in ``text`` and ``n_chars``, if present, counted anew; a null text stays null."""
    source = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redacted(t, spans(t)) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])
    found = arrow_rows(source, work, f"row {kind}, text string")
    kept = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0))}
    return found.select(*(kept[c].cast(docs.schema[c].dataType).alias(c) if c in kept else F.col(f"row.{c}").alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return marked(docs)
