"""Seeded sampling, splitting and folding by hash rank.

A row's place in its group depends on its id and the seed only: the same rows are drawn on any
number of partitions.  Ranks come from :func:`ordering.hash_rank`, so a label holding a large
part of the table is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col, sample_hash
from .filters import class_quantile_band
from .ordering import attach, hash_rank


def _clean(df: DataFrame, *extra: str) -> DataFrame:
    return df.drop("_rank", "n", *extra)


def cap_per_label(df: DataFrame, label: str, n: int, seed: int, id_col: str) -> DataFrame:
    """At most ``n`` rows per label, drawn at random."""
    ranked = hash_rank(df, [label], sample_hash(id_col, seed), id_col, keep_below=F.lit(n))
    return _clean(ranked.where(F.col("_rank") <= n))


def undersample(
    df: DataFrame, label: str, value: str, n: int, seed: int, id_col: str
) -> DataFrame:
    """Exactly ``n`` random rows of one label and all rows of the others.

    Fewer than ``n`` rows of the label is an error.
    """
    chosen = df.where(as_col(label) == value)
    ranked = hash_rank(chosen, [], sample_hash(id_col, seed), id_col)
    short = F.raise_error(F.lit(f"label {value!r} has fewer than {n} rows")).cast("boolean")
    kept = ranked.where(F.when(F.col("n") < n, short).otherwise(F.col("_rank") <= n))
    others = df.where((as_col(label) != value) | as_col(label).isNull())
    return others.unionByName(_clean(kept))


def sample_n(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """At most ``n`` random rows."""
    ranked = hash_rank(df, [], sample_hash(id_col, seed), id_col, keep_below=F.lit(n))
    return _clean(ranked.where(F.col("_rank") <= n))


def largest_remainder(
    counts: DataFrame, share: Column, total: Column, tie: Sequence[Column], name: str = "quota"
) -> DataFrame:
    """Whole-number quotas adding up to ``total``: floors first, leftovers by largest fraction.

    ``counts`` holds one row per group, so the window sees groups, not rows.
    """
    exact = counts.withColumn("_exact", share).withColumn("_base", F.floor("_exact"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy((F.col("_exact") - F.col("_base")).desc(), *tie)
    left = total - F.sum("_base").over(everything)
    return exact.withColumn(
        name,
        (F.col("_base") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).cast("bigint"),
    ).drop("_exact", "_base")


def stratified_sample_by_bin(
    df: DataFrame, x: str, y: str, n: int, bins: int, seed: int, id_col: str
) -> DataFrame:
    """At most ``n`` rows spread over equal-width bins of ``x``.

    Every non-empty bin gives one row, the rest of the quota follows the bin sizes.  Rows with
    a missing coordinate are left out; a table not larger than ``n`` is kept whole.
    """
    valid = df.where(as_col(x).isNotNull() & as_col(y).isNotNull())
    span = valid.agg(
        F.min(as_col(x)).alias("_lo"), F.max(as_col(x)).alias("_hi"), F.count(F.lit(1)).alias("_all")
    )
    wide = attach(valid, span, [])
    width = F.nullif((F.col("_hi") - F.col("_lo")) / F.lit(float(bins)), F.lit(0.0))
    place = F.floor((as_col(x) - F.col("_lo")) / width)
    binned = wide.withColumn(
        "_bin", F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")
    ).drop("_lo", "_hi")
    counts = binned.groupBy("_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_all").alias("_total")
    )
    used = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    spare = F.greatest(F.lit(n) - used, F.lit(0))
    counts = counts.withColumn("_spare", spare)
    quotas = largest_remainder(
        counts, F.col("_c") / F.col("_total") * F.col("_spare"), F.col("_spare"),
        [F.col("_bin").desc()], "_extra",
    ).select("_bin", F.least(F.col("_extra") + 1, F.col("_c")).alias("_quota"))
    ranked = hash_rank(
        attach(binned, quotas, ["_bin"]), ["_bin"], sample_hash(id_col, seed), id_col,
        keep_below=F.when(F.col("_all") <= n, F.col("_all")).otherwise(F.col("_quota")),
    )
    kept = ranked.where((F.col("_all") <= n) | (F.col("_rank") <= F.col("_quota")))
    return _clean(kept, "_bin", "_quota", "_all")


def proportional_sample(df: DataFrame, label: str, n: int, seed: int, id_col: str) -> DataFrame:
    """Per class its share of ``n`` rows, cut to a whole number, at least one."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    ranked = hash_rank(
        attach(df, total, []), [label], sample_hash(id_col, seed), id_col,
        keep_below=F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("n") / F.col("_all"))),
    )
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("n") / F.col("_all")))
    return _clean(ranked.where(F.col("_rank") <= quota), "_all")


def quota_sample(
    df: DataFrame, label: str, limits: Mapping[str, int], default: int, seed: int, id_col: str,
    bands: Mapping[str, tuple[str, float, float]] | None = None,
) -> DataFrame:
    """At most so many random rows per class, with per-class limits; optionally only rows in a
    quantile band of one feature of their class."""
    for cls, (feature, lo, hi) in (bands or {}).items():
        df = class_quantile_band(df, label, feature, lo, hi, only=[cls])
    quota = F.lit(default)
    for cls, limit in limits.items():
        quota = F.when(as_col(label) == cls, F.lit(limit)).otherwise(quota)
    ranked = hash_rank(df, [label], sample_hash(id_col, seed), id_col, keep_below=quota)
    return _clean(ranked.where(F.col("_rank") <= quota))


def label_index(df: DataFrame, label: str, order: str) -> DataFrame:
    """Index of every label by first appearance in the given row order: ``label, index``."""
    first = df.where(as_col(label).isNotNull()).groupBy(as_col(label)).agg(
        F.min(as_col(order)).alias("_first")
    )
    by_first = Window.partitionBy(F.lit(0)).orderBy("_first")  # one row per label
    return first.select(as_col(label), (F.row_number().over(by_first) - 1).alias("index"))


def factorize(
    df: DataFrame, label: str, order: str, index: DataFrame | None = None, out: str = "label_idx"
) -> DataFrame:
    """Rows with their label index; with a given (training) index an unknown label is an error."""
    given = index is not None
    lookup = (index if given else label_index(df, label, order)).withColumnRenamed("index", out)
    joined = attach(df, lookup, [label])
    if given:
        unknown = F.raise_error(F.concat(F.lit("unknown label: "), as_col(label))).cast("int")
        joined = joined.withColumn(out, F.coalesce(F.col(out), unknown))
    return joined


def stratified_split(
    df: DataFrame, label: str, test: float = 0.2, val: float = 0.0, seed: int = 32,
    id_col: str = "sample_id", rule: str = "exact",
) -> DataFrame:
    """Adds ``split``: train, test and, if asked for, val.

    ``exact``: held-out rows are ``ceil(n*share)`` overall, shared out by largest remainder
    with ties by label.  ``clamp``: per label ``round(n*test)`` kept inside ``[1, n-1]``, and a
    label of one row stays in train.
    """
    if not 0 < test < 1 or val < 0 or test + val >= 1:
        raise ValueError("shares must be above 0 and leave rows for training")
    counts = df.groupBy(as_col(label)).agg(F.count(F.lit(1)).alias("_c"))
    everything = Window.partitionBy(F.lit(0))
    if rule == "clamp":
        if val:
            raise ValueError("the clamp rule has no validation part")
        wanted = F.greatest(
            F.lit(1), F.least(F.col("_c") - 1, F.bround(F.col("_c") * F.lit(test)))
        )
        quotas = counts.withColumn("_held", F.when(F.col("_c") > 1, wanted).otherwise(0))
        quotas = quotas.withColumn("_test", F.col("_held"))
    elif rule == "exact":
        total = F.sum("_c").over(everything)
        counts = counts.withColumn("_goal", F.ceil(total * F.lit(test + val)))
        quotas = largest_remainder(
            counts, F.col("_c") * F.col("_goal") / total, F.col("_goal"), [as_col(label)], "_held"
        )
        if val:
            share = test / (test + val)
            held = F.sum("_held").over(everything)
            quotas = quotas.withColumn("_goal", F.ceil(held * F.lit(share)))
            quotas = largest_remainder(
                quotas, F.col("_held") * F.col("_goal") / held, F.col("_goal"),
                [as_col(label)], "_test",
            )
        else:
            quotas = quotas.withColumn("_test", F.col("_held"))
    else:
        raise ValueError(f"unknown rule: {rule}")
    ranked = hash_rank(df, [label], sample_hash(id_col, seed), id_col)
    placed = attach(ranked, quotas.select(as_col(label), "_held", "_test"), [label])
    split = (
        F.when(F.col("_rank") <= F.col("_test"), F.lit("test"))
        .when(F.col("_rank") <= F.col("_held"), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return _clean(placed.withColumn("split", split), "_held", "_test")


def stratified_folds(
    df: DataFrame, label: str, k: int = 5, seed: int = 32, id_col: str = "sample_id"
) -> DataFrame:
    """Adds ``fold`` in ``0..k-1``; every fold has each label's share to within one row."""
    ranked = hash_rank(df, [label], sample_hash(id_col, seed), id_col)
    return _clean(ranked.withColumn("fold", ((F.col("_rank") - 1) % F.lit(k)).cast("int")))


def split_summary(df: DataFrame, label: str, split: str = "split", digits: int = 4) -> DataFrame:
    """Rows and percent per label inside each split."""
    counts = df.groupBy(as_col(split), as_col(label)).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(as_col(split)))
    return counts.withColumn("percent", F.round(F.col("count") * 100.0 / total, digits))


def label_counts(df: DataFrame, label: str, digits: int = 2) -> DataFrame:
    """Rows and percent per label, NULL as UNKNOWN, largest first."""
    name = F.coalesce(as_col(label).cast("string"), F.lit("UNKNOWN"))
    counts = df.groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn(
        "percent", F.round(F.col("count") * 100.0 / total, digits)
    ).orderBy(F.desc("count"), "label")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights ``n/(k*n_c)`` divided by their mean: label, count, weight."""
    counts = df.groupBy(as_col(label)).agg(F.count(F.lit(1)).alias("count"))
    everything = Window.partitionBy(F.lit(0))
    raw = F.sum("count").over(everything) / (
        F.count(F.lit(1)).over(everything) * F.col("count")
    )
    weighted = counts.withColumn("_w", raw)
    return weighted.select(
        as_col(label), "count", (F.col("_w") / F.avg("_w").over(everything)).alias("weight")
    )

