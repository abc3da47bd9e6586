"""Union, deduplication, consolidation of split rows and key lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import any_true, as_col, to_number
from ..functions.text import citation_numbers, clean_text, or_unresolved
from .ordering import _join_small


def union_all(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedup_exact(df: DataFrame, id_col: str) -> DataFrame:
    """One row per distinct content, keeping the smallest id.

    A plain aggregation, so copies collapse before the shuffle.
    """
    content = [c for c in df.columns if c != id_col]
    return (
        df.groupBy(*[as_col(c) for c in content])
        .agg(F.min(as_col(id_col)).alias(id_col))
        .select(*[as_col(c) for c in df.columns])
    )


def dedup_fingerprint(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key in the given order; ``copies`` says how many rows shared the key."""
    rest = [c for c in df.columns if c not in order and c != key]
    row = F.struct(*[as_col(c) for c in order], *[as_col(c) for c in rest])
    best = df.groupBy(as_col(key)).agg(
        F.min(row).alias("_first"), F.count(F.lit(1)).alias("copies")
    )
    return best.select(
        *[as_col(c) if c == key else F.col("_first")[c].alias(c) for c in df.columns], "copies"
    )


def internal_duplicates(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of their key, per source."""
    per_key = df.groupBy(*[as_col(c) for c in by], as_col(key)).agg(F.count(F.lit(1)).alias("_c"))
    return per_key.groupBy(*[as_col(c) for c in by]).agg(
        F.sum(F.col("_c") - 1).alias("n_duplicates")
    )


def cross_duplicates(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``b`` whose key occurs in ``a``."""
    return b.join(a.select(as_col(key)).distinct().hint("merge"), key, "left_semi")


def consolidate_rows(
    df: DataFrame, sample: str, citation: str, value_cols: Sequence[str], order: str
) -> tuple[DataFrame, DataFrame]:
    """Merge complementary rows of one (sample, citation).

    Groups in which no measured column holds two different numbers become one row holding the
    first present entry of every column; other groups stay as they are.  Rows without a sample
    name are never merged; a missing citation is one key.  Gives the rows and a one-row table
    of ``safe_groups, conflict_groups, conflict_rows``.

    The conflict test is minimum against maximum, which combines on the map side.
    """
    if sample not in df.columns or citation not in df.columns:
        zero = df.sparkSession.range(1).select(
            *[F.lit(0).cast("bigint").alias(n)
              for n in ("safe_groups", "conflict_groups", "conflict_rows")]
        )
        return df, zero
    keyed = df.withColumns(
        {
            "_s": as_col(sample).cast("string"),
            "_lone": F.when(as_col(sample).isNull(), as_col(order).cast("string")),
            "_c": as_col(citation).cast("string"),
        }
    )
    keys = ["_s", "_lone", "_c"]
    conflict = any_true(
        [
            F.coalesce(F.min(to_number(c)) < F.max(to_number(c)), F.lit(False))
            for c in value_cols
        ]
    )
    contents = [c for c in df.columns if c != order]
    merged = keyed.groupBy(*keys).agg(
        conflict.alias("_conflict"),
        F.count(F.lit(1)).alias("_n"),
        F.min(as_col(order)).alias(order),
        *[
            F.min_by(as_col(c), F.when(as_col(c).isNotNull(), as_col(order))).alias(c)
            for c in contents
        ],
    )
    safe = merged.where(~F.col("_conflict")).select(*[as_col(c) for c in df.columns])
    clashing = merged.where("_conflict").select(*keys)
    raw = _join_small(keyed, clashing, keys).select(*[as_col(c) for c in df.columns])
    stats = merged.agg(
        F.count_if(~F.col("_conflict")).alias("safe_groups"),
        F.count_if("_conflict").alias("conflict_groups"),
        F.coalesce(F.sum(F.when(F.col("_conflict"), F.col("_n"))), F.lit(0)).alias("conflict_rows"),
    )
    return safe.unionByName(raw), stats


def citation_years(
    df: DataFrame, cite: str, refs: DataFrame, out: str = "PUBLICATION_YEAR",
    unknown: str = "drop",
) -> DataFrame:
    """Sorted distinct publication years of the bracketed reference numbers, else ``N/A``.

    ``refs`` has ``reference_number`` (unique) and ``year`` (text).  ``unknown='none_text'``
    writes a number absent from the lookup as the text ``None`` instead of dropping it.
    Every distinct citation text is resolved once and joined back.
    """
    texts = df.select(as_col(cite).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    numbers = texts.select("_t", F.explode(F.array_distinct(citation_numbers("_t"))).alias("_n"))
    lookup = refs.select(
        F.col("reference_number").cast("bigint").alias("_n"), _year_text("year").alias("_y")
    )
    found = numbers.join(lookup.withColumn("_hit", F.lit(True)), "_n", "left")
    year = F.when(F.col("_y") != "N/A", F.col("_y"))
    if unknown == "none_text":
        year = F.when(F.col("_hit").isNull(), F.lit("None")).otherwise(year)
    years = found.groupBy("_t").agg(
        F.array_join(F.array_sort(F.collect_set(year)), "; ").alias("_years")
    )
    joined = df.join(years, as_col(cite) == F.col("_t"), "left")
    return joined.withColumn(
        out, F.coalesce(F.nullif(F.col("_years"), F.lit("")), F.lit("N/A"))
    ).drop("_t", "_years")


def _year_text(c: str):
    """Year as text without a trailing decimal part."""
    return F.regexp_replace(as_col(c).cast("string"), r"\.0$", "")


def unit_key(source: str, region: str):
    """``source|region`` with cleaned texts and a stand-in for an unknown region."""
    return F.concat(clean_text(source), F.lit("|"), or_unresolved(clean_text(region)))


def apply_unit_results(
    df: DataFrame, results: DataFrame, source: str = "SOURCE_DATASET", region: str = "Craton"
) -> DataFrame:
    """Write unit-level naming results to the rows of their unit.

    The region is replaced only for a confirmed unit of at least medium confidence with a
    resolved name; the former region is kept in ``<region>_original``.
    """
    original = f"{region}_original"
    if original not in df.columns:
        df = df.withColumn(original, as_col(region))
    before = or_unresolved(clean_text(original))
    res = results.select(
        F.col("unit_id").alias("_u"),
        F.col("canonical_craton").alias(f"{region}_AI"),
        F.col("status").alias(f"{region}_AI_status"),
        F.col("confidence").alias(f"{region}_AI_confidence"),
        F.col("reason").alias(f"{region}_AI_reason"),
    )
    joined = df.join(res, unit_key(source, original) == F.col("_u"), "left")
    confirmed = (
        (F.col(f"{region}_AI_status") == "CRATON")
        & F.col(f"{region}_AI_confidence").isin("high", "medium")
        & (F.col(f"{region}_AI") != "Unresolved")
    )
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in res.columns if c != "_u"}
    final = F.when(confirmed, F.col(f"{region}_AI")).otherwise(before)
    return joined.withColumn(region, final).withColumns(texts).drop("_u")


def completed_units(
    done: DataFrame, order: str, source: str = "SOURCE_DATASET", region: str = "Craton"
) -> DataFrame:
    """Unit results found in an earlier output: the first row of every unit, named ones only."""
    needed = [f"{region}_original", f"{region}_AI", f"{region}_AI_status",
              f"{region}_AI_confidence", f"{region}_AI_reason"]
    if not set(needed) <= set(done.columns):
        return done.sparkSession.createDataFrame(
            [], "unit_id string, canonical_craton string, status string, confidence string, reason string"
        )
    first = done.groupBy(as_col(source), as_col(needed[0])).agg(
        F.min(F.struct(as_col(order).alias("_o"), *[as_col(c) for c in needed[1:]])).alias("_f")
    )
    return first.select(
        unit_key(source, needed[0]).alias("unit_id"),
        clean_text(F.col("_f")[needed[1]]).alias("canonical_craton"),
        clean_text(F.col("_f")[needed[2]]).alias("status"),
        clean_text(F.col("_f")[needed[3]]).alias("confidence"),
        clean_text(F.col("_f")[needed[4]]).alias("reason"),
    ).where(F.col("canonical_craton") != "")


def pending_units(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units without a completed result."""
    return units.join(done.select("unit_id"), "unit_id", "left_anti")


def sanitize_labels(df: DataFrame, text: str | None = None, reason_chars: int | None = None) -> DataFrame:
    """Constrain the four result fields to their vocabularies, with defaults.

    ``text`` names a JSON column holding the fields; without it they are plain columns.  Reasons
    stay whole unless ``reason_chars`` asks for their beginning only.
    """
    fields = ["canonical_craton", "status", "confidence", "reason"]
    if text is not None:
        schema = ", ".join(f"{f} string" for f in fields)
        df = df.withColumn("_j", F.from_json(as_col(text), schema))
        df = df.withColumns({f: F.col("_j")[f] for f in fields}).drop("_j")
    status = F.upper(clean_text("status"))
    status = F.when(status.isin(K.UNIT_STATUSES), status).otherwise(F.lit("UNKNOWN"))
    confidence = F.lower(clean_text("confidence"))
    confidence = F.when(confidence.isin(K.UNIT_CONFIDENCES), confidence).otherwise(F.lit("low"))
    name = clean_text("canonical_craton")
    unsettled = status.isin("NOT_A_CRATON", "UNKNOWN") & F.lower(name).isin(K.UNSETTLED_NAMES)
    name = F.when((name == "") | unsettled, F.lit("Unresolved")).otherwise(name)
    return df.withColumns(
        {
            "canonical_craton": name,
            "status": status,
            "confidence": confidence,
            "reason": clean_text("reason") if reason_chars is None else F.substring(clean_text("reason"), 1, reason_chars),
        }
    )


def attach_mask(df: DataFrame, mask: DataFrame, id_col: str, synthetic: str | None = None) -> DataFrame:
    """Missing mask joined by id; synthetic rows (absent from the mask) get 0.

    An original row without a mask row is an error.
    """
    cols = [c for c in mask.columns if c != id_col]
    joined = df.join(mask.withColumn("_has", F.lit(True)), id_col, "left")
    made = as_col(synthetic) if synthetic else F.lit(False)
    check = F.when(
        F.col("_has").isNull() & ~made, F.raise_error(F.lit("row without a missing mask"))
    )
    return joined.where(check.isNull()).withColumns(
        {c: F.coalesce(as_col(c), F.lit(0).cast(mask.schema[c].dataType)) for c in cols}
    ).drop("_has")
