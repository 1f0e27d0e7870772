"""Personal data: an Aho-Corasick pass finds anchors, local parsers expand each to a checked span.

Anchors are at-signs, plus signs, digit-run starts, `://` and identifier cue words. Each parser reads
only the text around its anchor, so a document is scanned once whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "iban", "login", "secret")
# Words that announce an identifier, each with the kind of its value.
CUES = {
    "ssn": "account", "account no": "account", "account number": "account", "passport": "account",
    "iban": "iban", "token": "secret", "password": "secret", "passwd": "secret", "api_key": "secret", "apikey": "secret", "secret": "secret",
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?: (?:no|number)\b)?\.?[:=#]? {0,3}([A-Z0-9]{2,4}-?[0-9]{2,4}-?[0-9]{2,8})\b", re.A)
_IBAN = re.compile(r"[:=]? {0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b", re.A)
_SECRET = re.compile(r"[\"']? {0,3}[:=] {0,3}[\"']?([A-Za-z0-9+/_-]{16,}+)")
_LOGIN = re.compile(r"://([^\s/:@?#]+:[^\s/@?#]+)@")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) spans in code points, end exclusive, without overlaps inside a base kind."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*BASE_KINDS, *MORE_KINDS), 0)
    for last, (what, width) in anchors.iter(text):
        at = last - width + 1
        if what == "digit":
            if at and text[at - 1].isascii() and text[at - 1].isdigit():
                continue
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                    out.append(("ip", *m.span()))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        elif what == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, last + 1)):
                done["email"] = m.end()
                out.append(("email", start, m.end()))
        elif what == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
                    out.append(("phone", *m.span()))
        elif what == "scheme":
            if m := _LOGIN.match(text, at):
                out.append(("login", *m.span(1)))
        elif at >= done[what] and (m := {"account": _ACCOUNT, "iban": _IBAN, "secret": _SECRET}[what].match(text, last + 1)):
            value = m[1]
            good = _iban_ok(value) if what == "iban" else any(x.isdigit() for x in value)
            if good:
                done[what] = m.end()
                out.append((what, *m.span(1)))
    return out


def spans_text(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted((x for x in spans if x[0] in order), key=lambda x: (order[x[0]], x[1], x[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            spans = find(text.as_py() or "", anchors)
            counts = [sum(s[0] == k for s in spans) for k in BASE_KINDS]
            base = hashlib.sha256(spans_text(spans, BASE_KINDS).encode()).hexdigest()
            rows.append((i, *counts, base, spans_text(spans, BASE_KINDS + MORE_KINDS)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: counts of the base kinds, a digest of their spans, and all spans.

    Null and empty texts hold no spans (digest of the empty string). Null ids and repeated rows are kept as
    they come, other columns ignored. Nothing is shuffled; a text of any length is scanned whole, and a secret may
    have any length from 16 characters on. An empty table gives no rows.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scan, SCHEMA)
