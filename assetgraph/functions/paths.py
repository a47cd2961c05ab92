"""Logical paths (`/a/b`) and column paths (dotted, `\\` escapes a dot)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trims every kind of white space, as the text functions need it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_path(c: Column) -> Column:
    """One leading slash, no trailing one, runs of slashes collapsed; null and empty become the root."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(F.trim(c), F.lit(""))), "/+", "/")
    return F.regexp_replace(p, "(.)/$", "$1")


def asset_path(path: Column, file: Column) -> Column:
    """The path of an asset: the path itself if it already ends with the file name."""
    tail = F.concat(F.lit("/"), file)
    return F.when((F.coalesce(file, F.lit("")) == "") | F.endswith(path, tail), path).otherwise(F.concat(F.when(path == "/", "").otherwise(path), tail))


def parent_path(p: Column) -> Column:
    """The folder of a normalised path; null for the root."""
    up = F.regexp_replace(p, "/[^/]*$", "")
    return F.when(p == "/", F.lit(None)).when(up == "", "/").otherwise(up)


def leaf_name(p: Column) -> Column:
    return F.regexp_extract(p, "([^/]*)$", 1)


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda x: x != "")


def depth(p: Column) -> Column:
    return F.size(segments(p))


def path_chain(p: Column) -> Column:
    """The root and every prefix down to the path itself, in order."""
    segs = segments(p)
    return F.transform(F.sequence(F.lit(0), F.size(segs)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(segs, 1, n), "/")))


def split_unescaped(p: Column) -> Column:
    """Segments between unescaped dots, still escaped; empty segments are dropped."""
    return F.regexp_extract_all(p, F.lit(r"((?:\\.|[^.\\])+)"), 1)


def unescape(seg: Column) -> Column:
    return F.regexp_replace(seg, r"\\(.)", "$1")


def escape(seg: Column) -> Column:
    return F.regexp_replace(seg, r"\.", r"\\.")


def count_segments(p: Column) -> Column:
    return F.size(split_unescaped(p))


def last_unescaped_dot(p: Column) -> Column:
    """The place of the last unescaped dot, from 0; -1 without one."""
    last = F.element_at(split_unescaped(p), -1)
    return F.when(count_segments(p) > 1, F.length(p) - F.length(last) - 1).otherwise(-1)


def to_data_path(path: Column) -> Column:
    """`/a/b.c` to `data.a.b\\.c`."""
    return F.concat(F.lit("data."), F.array_join(F.transform(segments(path), escape), "."))


def normalize_escaped_path(path: Column) -> Column:
    """Trimmed, runs of backslashes collapsed to one."""
    return F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\{2,}", r"\\")


def split_parent_leaf(path: Column) -> tuple[Column, Column]:
    """The column path before its last unescaped dot and what follows; both empty where a side is."""
    p = normalize_escaped_path(path)
    dot = last_unescaped_dot(p)
    inside = (dot > 0) & (dot < F.length(p) - 1)
    return F.when(inside, F.substring(p, F.lit(1), dot)).otherwise(""), F.when(inside, F.substring(p, dot + 2, F.length(p))).otherwise("")


def to_file_leaf_path(prefix: Column, file: Column) -> Column:
    """A file's column path below a prefix, its dots escaped; `content.bin` without a name."""
    name = F.regexp_replace(F.trim(F.coalesce(file, F.lit(""))), r"\\", "/")
    base = F.when(name.rlike("/[^/]+$"), leaf_name(name)).otherwise(name)
    return F.concat(prefix, F.lit("."), escape(F.when(base == "", "content.bin").otherwise(base)))


def quote_identifier_path(p: Column) -> Column:
    """Each segment in back quotes; a final `*` stays."""
    return F.array_join(F.transform(split_unescaped(p), lambda s: F.when(s == "*", s).otherwise(F.concat(F.lit("`"), s, F.lit("`")))), ".")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./]+)$", 1))


def base_name(name: Column) -> Column:
    """The last part of a path, without line breaks."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1), "[\r\n]", "")
