"""Keywords, summaries and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetgraph.functions.paths import strip

KEYWORD_CAP, ENTITY_CAP, TRIPLE_CAP = 80, 120, 180


def dedup_strings(values: Column, cap: int | None = None) -> Column:
    """Trimmed, non-empty, first occurrences in order, at most cap of them."""
    out = F.array_distinct(F.filter(F.transform(values, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    return F.slice(out, 1, cap) if cap else out


def parse_keywords(c: Column, cap: int = KEYWORD_CAP) -> Column:
    """A JSON array, or else words between commas."""
    c = F.coalesce(c, F.lit(""))
    parsed = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))
    return dedup_strings(F.coalesce(parsed, F.split(c, ",")), cap)


def bounded_summary(c: Column, n: int) -> Column:
    """White space collapsed; longer texts end after their last full stop past the middle, or with an ellipsis."""
    text = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    head = F.substring(text, 1, n)
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1)
    return F.when(F.length(text) <= n, text).when(F.length(cut) > n // 2, cut).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def token_estimate(c: Column) -> Column:
    ascii_ = F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", ""))
    return F.floor((ascii_ + 2) / 3) + 2 * (F.length(F.coalesce(c, F.lit(""))) - ascii_)


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, "(?is)^.*</think>", "")


def strip_code_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), "^```[A-Za-z]*\\s*", ""), "\\s*```$", "")


def salvage_object(c: Column) -> Column:
    """The outermost braces and what is between them; empty without any."""
    return F.regexp_extract(strip_code_fence(strip_think(c)), r"(?s)(\{.*\})", 1)


def confidence(c: Column) -> Column:
    value = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))), F.lit(0.0))


def content_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def path_filter(c: Column) -> Column:
    return F.regexp_extract(c, r"(/[a-zA-Z0-9_./-]*)", 1)
