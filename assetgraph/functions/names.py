"""Names of columns, fields and entities."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetgraph.functions.paths import strip
from assetgraph.operators.suffixes import suffixed


def sanitize_column(c: Column) -> Column:
    name = F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9_]", "_")
    return F.when(name == "", "col").when(name.rlike("^[0-9]"), F.concat(F.lit("c_"), name)).otherwise(name)


def sanitize_document_key(c: Column) -> Column:
    name = F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9_@$-]", "_")
    return F.when(name == "", "col").when(name.rlike("^[0-9]"), F.concat(F.lit("c_"), name)).otherwise(name)


def normalize_field(c: Column) -> Column:
    """The last dotted part without brackets at the ends and without characters outside letters, digits, `_`, `-` and Han; the second key header is `key`."""
    part = F.regexp_extract(F.regexp_replace(strip(c), "^[()]+|[()]+$", ""), r"([^.]*)$", 1)
    name = F.regexp_replace(part, r"[^A-Za-z0-9_\-一-龥]", "")
    return F.when(F.lower(name) == "key_2", "key").otherwise(name)


def normalize_column(c: Column) -> Column:
    """Without back quotes, unwrapped from one function call, the last dotted part."""
    plain = F.regexp_replace(c, "`", "")
    inner = F.when(plain.rlike(r"^[A-Za-z_]+\(.*\)$"), F.regexp_extract(plain, r"\((.*)\)$", 1)).otherwise(plain)
    return F.regexp_extract(inner, r"([^.]*)$", 1)


_ALNUM = string.ascii_lowercase + string.digits
_MARKS = "".join(c for c in map(chr, range(1, 128)) if c not in _ALNUM)


def entity_norm(c: Column) -> Column:
    """In lower case, without characters outside letters, digits and Han. Only words with others than ASCII need the pattern, which would take most of the time."""
    low = F.translate(F.lower(c), _MARKS, "")
    plain = F.translate(low, _ALNUM, "") == ""
    return F.when(plain, low).otherwise(F.regexp_replace(low, "[^a-z0-9一-龥]", ""))


def display_name(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def dedup_headers(df: DataFrame, group: str, position: str, name: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds `header`: blanks become `column_<position>`, repeats get `_2`, `_3` and so on within their group.

    A name that an earlier column has by its suffix moves on to the next one that is free.
    """
    filled = df.withColumn("_name", F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", F.concat(F.lit("column_"), F.col(position))).otherwise(F.trim(F.col(name))))
    return suffixed(filled, group, position, "_name", "_", "header", save).drop("_name")
