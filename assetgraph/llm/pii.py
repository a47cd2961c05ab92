"""Personal data by anchor expansion: an Aho-Corasick pass finds anchors, local parsers expand and check each one.

Anchors are at-signs, plus signs, digits, URL schemes and identifier cues. A parser reads outwards from its anchor
only and nothing twice, so the work is one automaton pass over the text and grows with its length alone.

Base kinds, in this order, each leftmost and non-overlapping: email, ip, card, phone. The cues add `secret`
(values after password, token and the like, cloud key ids), `iban` and `url` (URLs that carry a user or an id after a
scheme). Added kinds never displace a base span. Offsets are code points, ends exclusive. A null text is empty; a null
doc_id stays null; repeated rows each get a row; tables may have further columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.jobs import bounded, doc_texts, map_blocks

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "url")
KINDS = BASE + ADDED
CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "akia", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_VALUE = re.compile(r"[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,})")
_KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_IBAN = re.compile(r"[a-z]{0,8}[ :]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_RUN = re.compile(r"[^\s\"'<>]*")
_USER = re.compile(r"[^\s/@\"'<>]+@[^\s\"'<>]")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, marks in (("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("scheme", ["://"])):
        for m in marks:
            found.add_word(m, (kind, m))
    for cue in CUES:
        found.add_word(cue, ("cue", cue))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _email(text: str, at: int, after: int) -> Span | None:
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def _added(text: str, cue: str, start: int, end: int) -> tuple[str, Span] | None:
    if cue == "akia":
        m = _KEY_ID.match(text, start)
        return ("secret", m.span()) if m and not (start and text[start - 1].isalnum()) else None
    if cue == "iban":
        m = _IBAN.match(text, end)
        return ("iban", m.span(1)) if m and _iban_valid(m[1]) else None
    m = _VALUE.match(text, end)
    return ("secret", m.span(1)) if m else None


def find(text: str) -> dict[str, list[Span]]:
    """All spans of each kind, ascending."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    upto = dict.fromkeys(KINDS, 0)
    last_digit, run_end, last_query = -2, 0, -1
    for i, (anchor, mark) in _anchors().iter(_lower(text)):
        if anchor == "digit":
            starts_run, last_digit = i != last_digit + 1, i
            if not starts_run:
                continue
            if i >= upto["ip"] and (m := _IP.match(text, i)):
                upto["ip"] = m.end()
                if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                    out["ip"].append(m.span())
            if i >= upto["card"] and (m := _CARD.match(text, i)):
                upto["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif anchor == "plus":
            if i >= upto["phone"] and (m := _PHONE.match(text, i)):
                upto["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif anchor == "at":
            if span := _email(text, i, upto["email"]):
                upto["email"] = span[1]
                out["email"].append(span)
        elif anchor == "scheme":
            if i >= run_end:  # a run without white space is looked through once, however many schemes stand in it
                run_end = _RUN.match(text, i + 1).end()
                last_query = text.rfind("?", i + 1, run_end)
            start = i - 2
            while start > upto["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < i - 2 and (last_query > i or _USER.match(text, i + 1)):
                out["url"].append((start, run_end))
                upto["url"] = run_end
        elif found := _added(text, mark, i - len(mark) + 1, i + 1):
            kind, span = found
            if span[0] >= upto[kind]:
                out[kind].append(span)
                upto[kind] = span[1]
    return out


def _joined(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(block: pa.RecordBatch) -> pa.RecordBatch:
    rows: list[list] = [[] for _ in range(6)]
    for text in block.column("text").to_pylist():
        found = find(text or "")
        for column, value in zip(rows, (*(len(found[k]) for k in BASE), hashlib.sha256(_joined(found, BASE).encode()).hexdigest(), _joined(found, KINDS)), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays(
        [block.column("doc_id"), *(pa.array(x, pa.int64()) for x in rows[:4]), *(pa.array(x, pa.string()) for x in rows[4:])],
        ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans, a row for each document."""
    return map_blocks(doc_texts(docs), "text", _scan, SCHEMA)


def mask_text(text: str, found: dict[str, list[Span]]) -> str:
    """The text with every span, or overlapping spans together, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, spans in found.items() for a, b in spans):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data masked in the text (null stays null) and, where there is one, n_chars set anew."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = names.index(text)
        for b in batches:
            new = [t if t is None else mask_text(t, find(t)) for t in b.column(i).to_pylist()]
            columns = [pa.array(new, b.schema.field(i).type) if k == i else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = bounded(docs).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length(text).cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op6_pii(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    return scan(table(spark, sf_dir, "documents"))
