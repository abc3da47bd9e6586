"""Ranks, quantiles and running sums that never put a whole group into one task.

A window over ``partitionBy(group)`` sorts a group in a single task, and ``percentile`` holds
all distinct values of a group in one buffer; both break once a group holds a large part of a
huge table.  The operators here cut each group into value buckets first:

1. rows are counted per (group, bucket), which combines on the map side;
2. a window over the few buckets of a group gives the offset at which every bucket starts;
3. only inside a bucket are rows sorted, so one task sees one bucket.

The bucket of a value depends on the value alone (exponent and leading mantissa bits), never on
a sample of the data, so recomputing a lost task gives the same buckets.  Equal values are
counted together before any sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import SAMPLE_BITS, as_col

_STEPS = 1024  # buckets per doubling of the value


def order_bucket(v: Column, steps: int = _STEPS) -> Column:
    """Whole number that never decreases as ``v`` grows."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    mantissa = F.floor(size / F.pow(F.lit(2.0), exponent) * F.lit(float(steps)))
    key = (exponent + F.lit(1100)) * F.lit(4 * steps) + mantissa
    endless = F.lit(2**40)
    return (
        F.when(v == 0, F.lit(0))
        .when(size == float("inf"), F.when(v > 0, endless).otherwise(-endless))
        .when(v > 0, key)
        .otherwise(-key)
        .cast("bigint")
    )


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of key columns; the right ones carry a prefix."""
    return reduce(
        lambda a, b: a & b,
        [left[_q(k)].eqNullSafe(right[_q(prefix + k)]) for k in keys],
    )


def _q(name: str) -> str:
    return "`" + name + "`"


def _join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join that keeps the left key columns only.

    No broadcast is forced: the engine picks it from the measured size, and splits skewed
    partitions of the left side otherwise.
    """
    renamed = small.withColumnsRenamed({k: "_r_" + k for k in keys})
    joined = df.join(renamed, same_keys(df, renamed, keys, "_r_"), how)
    return joined.drop(*["_r_" + k for k in keys])


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Running sums along a value, per group: one row per distinct (keys, value).

    For every name in ``sums`` gives ``name`` (sum over rows with this value), ``cum_name``
    (this and all earlier values) and ``total_name`` (whole group).  Rows with NULL value are
    left out.
    """
    keys = list(keys)
    names = list(sums)
    base = df.where(as_col(value).isNotNull()).withColumn("_b", order_bucket(as_col(value)))
    distinct = base.groupBy(*[as_col(k) for k in keys], "_b", as_col(value)).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    direction = F.col("_b").desc() if descending else F.col("_b").asc()
    per_group = Window.partitionBy(*[as_col(k) for k in keys] or [F.lit(0)])
    running = per_group.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        base.groupBy(*[as_col(k) for k in keys], "_b")
        .agg(*[F.sum(c).alias("_n_" + n) for n, c in sums.items()])
        .select(
            *[as_col(k) for k in keys],
            "_b",
            *[F.coalesce(F.sum("_n_" + n).over(running), F.lit(0)).alias("_s_" + n) for n in names],
            *[F.sum("_n_" + n).over(per_group).alias("total_" + n) for n in names],
        )
    )
    joined = _join_small(distinct, starts, [*keys, "_b"])
    inside = (
        Window.partitionBy(*[as_col(k) for k in keys], "_b")
        .orderBy(as_col(value).desc() if descending else as_col(value).asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.select(
        *[as_col(k) for k in keys],
        as_col(value),
        *names,
        *[(F.col("_s_" + n) + F.sum(n).over(inside)).alias("cum_" + n) for n in names],
        *["total_" + n for n in names],
    )


def pick_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Column, carry: bool = True
) -> DataFrame:
    """Values at given 0-based positions of each sorted group.

    ``ranks`` is an array expression over the column ``n`` (rows of the group).  Gives one row
    per group: keys, ``n`` and ``picked``, a map from position to value.  Only buckets that
    hold a wanted position are read a second time and sorted.
    """
    keys = list(keys)
    key_cols = [as_col(k) for k in keys]
    base = (
        df.select(*key_cols, as_col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_b", order_bucket(F.col("_v")))
    )
    per_group = Window.partitionBy(*(key_cols or [F.lit(0)]))
    running = per_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = (
        base.groupBy(*key_cols, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            *key_cols,
            "_b",
            (F.sum("_c").over(running) - F.col("_c")).alias("_lo"),
            F.sum("_c").over(running).alias("_hi"),
            F.sum("_c").over(per_group).alias("n"),
        )
        .withColumn("_ranks", F.array_distinct(ranks))
        .withColumn(
            "_ranks",
            F.filter("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))),
        )
        .where(F.size("_ranks") > 0)
        .drop("_hi")
    )
    counted = (
        _join_small(base, wanted.select(*key_cols, "_b"), [*keys, "_b"])
        .groupBy(*key_cols, "_b", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    inside = (
        Window.partitionBy(*key_cols, "_b")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        _join_small(counted, wanted, [*keys, "_b"])
        .withColumn("_end", F.col("_lo") + F.sum("_c").over(inside))
        .withColumn(
            "_ranks",
            F.filter(
                "_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))
            ),
        )
        .select(*key_cols, "n", F.explode("_ranks").alias("_rank"), "_v")
    )
    return placed.groupBy(*key_cols).agg(
        F.max("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("picked"),
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q"
) -> DataFrame:
    """Exact quantiles with linear interpolation: keys, ``n`` and an array column.

    Groups without any value do not appear.
    """
    positions = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in probs])
    ranks = F.concat(
        F.transform(positions, lambda h: F.floor(h)), F.transform(positions, lambda h: F.ceil(h))
    )
    picked = pick_ranks(df, keys, value, ranks)
    lower = lambda h: F.element_at("picked", F.floor(h))
    upper = lambda h: F.element_at("picked", F.ceil(h))
    return picked.select(
        *[as_col(k) for k in keys],
        "n",
        F.transform(
            positions, lambda h: lower(h) + (upper(h) - lower(h)) * (h - F.floor(h))
        ).alias(name),
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per group: keys and the median."""
    return exact_quantiles(df, keys, value, [0.5], "_q").select(
        *[as_col(k) for k in keys], F.get("_q", 0).alias(name)
    )


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join by key columns, keeping the left key columns."""
    if not keys:  # ``small`` is a one-row global aggregate: read it as a scalar subquery
        row = small.select(F.struct("*").alias("_row")).scalar()
        return (
            df.withColumn("_row", row)
            .select(*[as_col(c) for c in df.columns], "_row.*")
        )
    return _join_small(df, small, keys, how)


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    tie: str,
    name: str = "_rank",
    keep_below: Column | None = None,
    bucket_bits: int = 12,
) -> DataFrame:
    """1-based rank of every row in its group, ordered by a uniform hash.

    ``order`` must be a whole number spread evenly over [0, 2**60); ``bucket_bits`` leading bits cut
    a group into buckets (raise them for groups of many billion rows).  ``keep_below`` drops
    whole buckets whose first rank is above the wanted one before anything is sorted; the
    column may use ``n`` (rows of the group).  Adds ``name`` and ``n``.
    """
    keys = list(keys)
    key_cols = [as_col(k) for k in keys]
    base = df.withColumn("_h", order).withColumn(
        "_hb", F.shiftright("_h", SAMPLE_BITS - bucket_bits).cast("int")
    )
    per_group = Window.partitionBy(*(key_cols or [F.lit(0)]))
    before = per_group.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        base.groupBy(*key_cols, "_hb")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            *key_cols,
            "_hb",
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_lo"),
            F.sum("_c").over(per_group).alias("n"),
        )
    )
    joined = _join_small(base, starts, [*keys, "_hb"])
    if keep_below is not None:
        joined = joined.where(F.col("_lo") < keep_below)
    inside = Window.partitionBy(*key_cols, "_hb").orderBy("_h", as_col(tie))
    return joined.withColumn(name, F.col("_lo") + F.row_number().over(inside)).drop(
        "_h", "_hb", "_lo"
    )
