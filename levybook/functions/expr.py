"""Column expressions shared by the operators.  All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def lit_dim(spark, rows, schema):
    """A literal dimension.  Its size is fixed by the source code, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def choose(mapping: dict, key: Column, default=None) -> Column:
    """A literal lookup that stays an expression (no join)."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


# -- dates ------------------------------------------------------------------

def iso_shaped(c: Column) -> Column:
    """Year-month-day digits with month 1-12, day 1-31, year from 1800.

    Only the shape is tested, so the 31st of February passes here.
    """
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.coalesce(
        shape
        & F.substring(c, 6, 2).try_cast("int").between(1, 12)
        & F.substring(c, 9, 2).try_cast("int").between(1, 31)
        & (F.substring(c, 1, 4).try_cast("int") >= 1800), F.lit(False))


def lenient_date(c: Column) -> Column:
    """ISO text to DATE; days past month end roll over, anything else is null."""
    ok = c.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")
    y, m = F.substring(c, 1, 4).try_cast("int"), F.substring(c, 6, 2).try_cast("int")
    d = F.substring(c, 9, 2).try_cast("int")
    return F.when(ok, F.date_add(F.make_date(y, m, F.lit(1)), d - 1))


def text_year(c: Column) -> Column:
    """Leading four digits as a year, else null."""
    return F.when(c.rlike(r"^\d{4}"), F.substring(c, 1, 4).cast("int"))


# -- text -------------------------------------------------------------------

def squash(c: Column) -> Column:
    """Runs of whitespace become one space."""
    return F.regexp_replace(c, r"\s+", " ")


def loose(c: Column) -> Column:
    """Lower case, everything but letters, digits and . % $ collapsed to a space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9.%$]+", " "))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def place_key(name: Column) -> Column:
    """Comparable form of a place name: civic suffixes off (three at most), upper case."""
    longest_first = sorted(fixed.CIVIC_SUFFIXES, key=len, reverse=True)
    tail = r"(?i)\s+(" + "|".join(longest_first) + r")$"
    s = F.trim(F.coalesce(name, F.lit("")))
    for _ in range(3):
        s = F.trim(F.regexp_replace(s, tail, ""))
    s = F.replace(F.replace(F.upper(s), F.lit("&"), F.lit("AND")), F.lit("."), F.lit(""))
    s = F.regexp_replace(s, r"\bST\b", "SAINT")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^A-Z0-9 ]", " "), r"\s+", " "))


def contains_any(c: Column, parts: Iterable[str]) -> Column:
    """One compiled pattern for all parts keeps the generated code small."""
    return c.rlike("|".join(r"\Q" + p + r"\E" for p in parts))


# -- urls -------------------------------------------------------------------

def url_host(url: Column) -> Column:
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(h)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def path_ext(path: Column) -> Column:
    """Lower-case extension with its dot, or '' when the last segment has none."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(last.contains("."), F.lower(F.regexp_extract(last, r"(\.[^.]*)$", 1))).otherwise(F.lit(""))


def is_document_url(url: Column) -> Column:
    return path_ext(url_path(url)).isin(fixed.DOCUMENT_EXTENSIONS)


def keyword_pattern(csv: str) -> str | None:
    """One pattern for extra keyword phrases; a gap matches space, '-', '_' or nothing."""
    words = [w.split() for w in (csv or "").split(",")]
    parts = [r"[\s_\-]?".join(re.escape(p) for p in w) for w in words if w]
    return "|".join(parts) if parts else None
