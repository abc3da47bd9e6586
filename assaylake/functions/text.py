"""Text column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import as_col


def clean_age(c: str | Column) -> Column:
    """Age text without bracketed reference numbers; NULL gives an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"\s*\[\d+\]", ""))


def first_int(c: str | Column) -> Column:
    """First run of digits as a number."""
    digits = F.regexp_extract(as_col(c).cast("string"), r"(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def is_archean(age: str | Column, prefix: str | Column | None = None) -> Column:
    """Does the (prefixed) age text name the oldest eon?"""
    text = F.coalesce(as_col(age).cast("string"), F.lit(""))
    if prefix is not None:
        text = F.concat(F.coalesce(as_col(prefix).cast("string"), F.lit("")), F.lit(" "), text)
    return F.upper(text).contains("ARCHEAN")


def reference_years(c: str | Column) -> Column:
    """Years of ``AUTHOR, YYYY`` mentions in order, repeats kept, joined by ``'; '``."""
    hits = F.regexp_extract_all(as_col(c), F.lit(r"[A-Z-]+,\s*(\d{4})"), F.lit(1))
    return F.coalesce(F.array_join(hits, "; "), F.lit(""))


def citation_numbers(c: str | Column) -> Column:
    """All bracketed reference numbers of a citation text."""
    hits = F.regexp_extract_all(as_col(c), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.transform(hits, lambda x: x.try_cast("bigint"))


def recode(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace known labels, leave the others as they are."""
    c = as_col(c)
    return F.coalesce(_lookup(c, mapping), c)


def abbreviate(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace known labels, NULL for the others."""
    return _lookup(as_col(c), mapping)


def _lookup(c: Column, mapping: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def canonical_label(c: str | Column) -> Column:
    """Trimmed upper-case label; NULL and the text ``NAN`` are both missing."""
    text = F.upper(F.trim(as_col(c).cast("string")))
    return F.nullif(text, F.lit("NAN"))


def clean_text(c: str | Column) -> Column:
    """Single blanks, trimmed; NULL and ``nan`` give an empty text."""
    text = F.trim(F.regexp_replace(F.coalesce(as_col(c).cast("string"), F.lit("")), r"\s+", " "))
    return F.regexp_replace(text, "^(?i:nan)$", "")


def or_unresolved(text: Column) -> Column:
    """An empty text becomes ``Unresolved``.  One pass, as the text is a nested expression."""
    return F.regexp_replace(text, "^$", "Unresolved")


def craton_from_location(c: str | Column) -> Column:
    """Region name out of a ``/`` separated path.

    The last part naming a craton wins, then the first naming a province or shield, then the
    first part.
    """
    parts = F.filter(F.transform(F.split(as_col(c), "/"), lambda p: F.trim(p)), lambda p: p != "")
    cratons = F.filter(parts, lambda p: F.upper(p).contains("CRATON"))
    wider = F.filter(
        parts, lambda p: F.upper(p).contains("PROVINCE") | F.upper(p).contains("SHIELD")
    )
    chosen = F.coalesce(F.try_element_at(cratons, F.lit(-1)), F.get(wider, 0), F.get(parts, 0))
    plain = F.replace(F.replace(chosen, F.lit("_ARCHEAN")), F.lit(" - ARCHEAN"))
    name = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.coalesce(name, F.lit(K.UNMATCHED_REGION))
