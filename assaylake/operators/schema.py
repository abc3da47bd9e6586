"""Column naming, alignment and checks (driver-side over names, projections over data)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K
from ..functions.numeric import as_col, to_number


def column_key(name: str) -> str:
    """Spelling-insensitive key of a column name: upper case without blanks and underscores."""
    return re.sub(r"[\s_]+", "", name).upper()


def find_column(df: DataFrame, name: str, aliases: Iterable[str] = ()) -> str | None:
    """Actual column for a wanted name; the first matching spelling wins, and of several
    columns with the same key the last one."""
    by_key = {column_key(c): c for c in df.columns}
    for wanted in (name, *aliases):
        hit = by_key.get(column_key(wanted))
        if hit is not None:
            return hit
    return None


def add_standard_columns(
    df: DataFrame,
    columns: Sequence[str],
    aliases: Mapping[str, Sequence[str]] | None = None,
    optional: Sequence[str] = (),
) -> DataFrame:
    """Add wanted columns under their standard names; absent required ones raise."""
    aliases = aliases or {}
    found, absent = {}, []
    for wanted in [*columns, *optional]:
        if wanted in df.columns:
            continue
        source = find_column(df, wanted, aliases.get(wanted, ()))
        if source is not None:
            found[wanted] = as_col(source)
        elif wanted in columns:
            absent.append(wanted)
    if absent:
        raise KeyError(f"required columns are missing: {absent}")
    return df.withColumns(found) if found else df


def normalize_names(df: DataFrame, mode: str = "strip_all") -> DataFrame:
    """Plain column names.  ``strip_all`` drops bracketed units and punctuation and upper-cases;
    ``units_only`` drops just the two unit suffixes."""
    if mode == "strip_all":
        names = [
            re.sub(r"[^0-9A-Za-z]+", "", re.sub(r"\(.*?\)", "", c)).upper() for c in df.columns
        ]
    elif mode == "units_only":
        names = [c.replace("(WT%)", "").replace("(PPM)", "").strip() for c in df.columns]
    else:
        raise ValueError(f"unknown mode: {mode}")
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after cleaning: {clashes}")
    return df.toDF(*names)


def extract_features(df: DataFrame, keep: Sequence[str] = (), lenient: bool = False) -> DataFrame:
    """The 36 features as numbers under short names, read from short or long names."""
    picked, absent = [], []
    for short, long in K.SHORT_TO_LONG.items():
        source = short if short in df.columns else long if long in df.columns else None
        if source is not None:
            picked.append(to_number(source).alias(short))
        elif lenient:
            picked.append(F.lit(None).cast("double").alias(short))
        else:
            absent.append(short)
    if absent:
        raise KeyError(f"features are missing: {absent}")
    return df.select(*[as_col(c) for c in keep], *picked)


def short_to_long(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(K.SHORT_TO_LONG)


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Listed columns as numbers; absent ones are skipped."""
    return df.withColumns({c: to_number(c) for c in cols if c in df.columns})


def restore_original(
    filtered: DataFrame, raw: DataFrame, id_col: str, updated: Sequence[str]
) -> DataFrame:
    """All raw columns of the surviving rows, with the updated columns taken from the filter."""
    new = filtered.select(id_col, *[as_col(c).alias("_new_" + c) for c in updated])
    kept = [c for c in raw.columns if c not in updated]
    return raw.join(new, id_col, "inner").select(
        *[as_col(c) for c in kept], *[as_col("_new_" + c).alias(c) for c in updated]
    )


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns, order and types of a reference schema; absent columns are NULL."""
    return df.select(
        *[
            (
                as_col(f.name).try_cast(f.dataType)
                if f.name in df.columns
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in schema.fields
        ]
    )


def columns_last(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(
        *[as_col(c) for c in df.columns if c not in cols],
        *[as_col(c) for c in cols if c in df.columns],
    )


def feature_faults(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with, per column, how many cells are NULL, NaN or infinite."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise KeyError(f"features are missing: {absent}")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.agg(*[F.count_if(bad(as_col(c).cast("double"))).alias(c) for c in cols])


def validate_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pass the table through when all cells are present and finite, else raise with counts."""
    faults = {c: n for c, n in feature_faults(df, cols).first().asDict().items() if n}
    if faults:
        raise ValueError(f"missing or non-finite cells: {faults}")
    return df


def label_problems(df: DataFrame, label: str, at_least: int) -> DataFrame:
    """Labels that are NULL or held by too few rows."""
    counts = df.groupBy(as_col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("label").isNull() | (F.col("n") < at_least))


def validate_labels(df: DataFrame, label: str, at_least: int = 5) -> DataFrame:
    if label not in df.columns:
        raise KeyError(f"label column is missing: {label}")
    problems = label_problems(df, label, at_least).orderBy("label")
    some = problems.take(20)
    if some:
        raise ValueError(f"{problems.count()} labels missing or too rare, first: {[(r.label, r.n) for r in some]}")
    return df


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """Pass the table through when it has exactly ``n`` rows."""
    found = df.count()
    if found != n:
        raise ValueError(f"expected {n} rows, found {found}")
    return df
