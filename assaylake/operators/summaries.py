"""Grouped summaries: age bins, regions, cases, components, drift, runs.

Counts, means and shares are one aggregation with conditional counts; medians and quantiles
come from :mod:`ordering`, so no group is collected.  Per-bin tables hold one row per bin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col, ratio_nz, ratio_pos
from ..functions.text import clean_text, is_archean, or_unresolved
from .dedup import unit_key
from .ordering import attach, exact_median, exact_quantiles


def _n() -> Column:
    return F.count(F.lit(1))


def _true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def share(flag: Column, scale: float = 1.0) -> Column:
    """Share of all rows for which a flag holds; NULL counts as false."""
    return F.lit(scale) * F.count_if(_true(flag)) / _n()


def part_of(part: Column, whole: Column) -> Column:
    """count(part)/count(whole), NULL when the latter is empty."""
    return F.try_divide(F.count_if(_true(part)), F.count_if(_true(whole)))


# --- age bins ---------------------------------------------------------------------------------


def age_bin(age: Column, width: float) -> Column:
    """Left-closed bin ``(lo, mid, hi)`` starting at a multiple of the width; NULL stays NULL."""
    lo = F.floor(age / F.lit(float(width))).cast("double") * F.lit(float(width))
    return F.when(
        age.isNotNull(),
        F.struct(lo.alias("lo"), (lo + width / 2.0).alias("mid"), (lo + float(width)).alias("hi")),
    )


def add_age_bins(df: DataFrame, age: str | Column, width: float = 200.0) -> DataFrame:
    """Adds ``age_bin``, ``age_bin_mid_ma`` and a label in Ga (empty when there is no age)."""
    binned = df.withColumn("age_bin", age_bin(as_col(age), width))
    ga = lambda c: F.format_number(F.col(c) / 1000.0, 1)
    label = F.concat(ga("age_bin.lo"), F.lit("–"), ga("age_bin.hi"), F.lit(" Ga"))
    return binned.withColumns(
        {
            "age_bin_mid_ma": F.col("age_bin.mid"),
            "age_bin_label": F.coalesce(label, F.lit("")),
        }
    )


def _mid_ga() -> Column:
    return (F.col("age_bin.mid") / 1000.0).alias("age_mid_ga")


def _by_bin(df: DataFrame, *keys) -> object:
    return df.where(F.col("age_bin").isNotNull()).groupBy(F.col("age_bin"), *keys)


def bin_text() -> Column:
    return F.concat(
        F.col("age_bin.lo").cast("bigint").cast("string"), F.lit("–"),
        F.col("age_bin.hi").cast("bigint").cast("string"), F.lit(" Ma"),
    ).alias("age_bin")


def summarize_by_age(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Counts and shares per age bin: all, high confidence, arc, baseline and every class."""
    high, arc = F.col("is_high_confidence"), F.col("is_arc_related_9class")
    base = F.col("liu_arc_binary")
    out = _by_bin(df).agg(
        _n().alias("n_all"),
        F.count_if(high).alias("n_high"),
        F.count_if(arc).alias("n_9class_arc_all"),
        share(arc).alias("ratio_9class_arc_all"),
        F.avg("Arc_probability3").alias("mean_arc_probability"),
        share(F.col("Arc_probability3") >= 0.5).alias("ratio_arc_probability_ge_0_5"),
        F.count_if(high & arc).alias("n_9class_arc_high"),
        part_of(high & arc, high).alias("ratio_9class_arc_high"),
        F.count(base).alias("n_liu_samples"),
        F.count_if(base).alias("n_liu_arc"),
        part_of(base, base.isNotNull()).alias("ratio_liu_arc"),
        F.avg("pred_prob_max").alias("mean_pred_prob"),
        *[F.count_if(F.col("pred_class_name") == c).alias(f"n_{c}") for c in classes],
        *[share(F.col("pred_class_name") == c).alias(f"ratio_{c}") for c in classes],
    )
    rest = [as_col(c) for c in out.columns if c != "age_bin"]
    return out.select(bin_text(), _mid_ga(), *rest).orderBy(F.desc("age_mid_ga"))


def baseline_by_age(df: DataFrame, age: str, probability: str, width: float = 200.0) -> DataFrame:
    """Share of an outside probability at 0.5 per age bin; rows missing either are left out."""
    rows = df.where(as_col(age).isNotNull() & as_col(probability).isNotNull())
    rows = rows.withColumn("age_bin", age_bin(as_col(age), width))
    hit = as_col(probability) >= 0.5
    return (
        _by_bin(rows)
        .agg(_n().alias("n_liu_samples"), F.count_if(hit).alias("n_liu_arc"),
             share(hit).alias("ratio_liu_arc"))
        .select(_mid_ga(), "n_liu_samples", "n_liu_arc", "ratio_liu_arc")
        .orderBy(F.desc("age_mid_ga"))
    )


def arc_ratio(df: DataFrame, thresholds: Sequence[float] = (0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Share of a bin's rows whose arc share reaches a threshold, one row per bin and threshold."""
    hits = [F.col("Arc_probability3") >= t for t in thresholds]
    counted = _by_bin(df).agg(
        _n().alias("_n"), *[F.count_if(h).alias(f"_h{i}") for i, h in enumerate(hits)]
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_h{i}").alias("n_high"))
        for i, t in enumerate(thresholds)
    ]))
    return counted.select(_mid_ga(), "_n", rows.alias("t")).select(
        "age_mid_ga", "t.threshold", "t.n_high",
        (F.col("t.n_high") / F.col("_n")).alias("ratio_arc"),
    )


def summarize_regions(df: DataFrame, region: str = "Craton", age: str = "C_AGE") -> DataFrame:
    """Per region (NULL kept): counts, age range of high-confidence arc rows, baseline counts and
    the most frequent class among them (smallest name on ties)."""
    high = F.col("is_high_confidence")
    chosen = _true(high & F.col("is_arc_related_9class"))
    base = _true(F.col("liu_arc_binary"))
    when_chosen = lambda c: F.when(chosen, as_col(c))
    main = df.groupBy(as_col(region)).agg(
        _n().alias("n_all"),
        F.count_if(high).alias("n_high"),
        F.count_if(chosen).alias("n_9class_arc_high"),
        F.max(when_chosen(age)).alias("oldest_9class_arc_high_C_AGE_Ma"),
        F.min(when_chosen(age)).alias("youngest_9class_arc_high_C_AGE_Ma"),
        F.count_if(base).alias("n_liu_arc"),
        F.max(F.when(base, as_col(age))).alias("oldest_liu_arc_C_AGE_Ma"),
    )
    per_class = df.where(chosen).groupBy(as_col(region), "pred_class_name").agg(_n().alias("_c"))
    dominant = per_class.groupBy(as_col(region)).agg(
        F.min(F.struct((-F.col("_c")).alias("_o"), F.col("pred_class_name").alias("name")))["name"]
        .alias("dominant_high_arc_class")
    )
    return (
        attach(main, dominant, [region])
        .withColumn(
            "dominant_high_arc_class", F.coalesce("dominant_high_arc_class", F.lit("")))
        .orderBy(F.desc_nulls_last("oldest_9class_arc_high_C_AGE_Ma"), F.desc("n_9class_arc_high"))
    )


INDICATORS = {"Ba_Th": ("BA", "TH"), "Th_Nb": ("TH", "NB"), "Ba_La": ("BA", "LA")}


def summarize_indicators(
    df: DataFrame, ratios: Mapping[str, tuple[str, str]] = INDICATORS
) -> DataFrame:
    """Mean and median of ratios per age bin for all rows and for high-confidence arc rows."""
    chosen = _true(F.col("is_high_confidence") & F.col("is_arc_related_9class"))
    subsets = F.filter(
        F.array(F.lit("all"), F.when(chosen, F.lit("high_9class_arc"))), lambda s: s.isNotNull()
    )
    rows = df.where(F.col("age_bin").isNotNull()).select(
        "age_bin", F.explode(subsets).alias("subset"),
        *[ratio_nz(n, d).alias(name) for name, (n, d) in ratios.items()],
    )
    out = rows.groupBy("age_bin", "subset").agg(
        _n().alias("n"), *[F.avg(name).alias(f"mean_{name}") for name in ratios]
    )
    long = _ratio_rows(rows, ["age_bin", "subset"], ratios)
    medians = exact_median(long, ["age_bin", "subset", "ratio"], "value", "m")
    wide = medians.groupBy("age_bin", "subset").agg(
        *[F.max(F.when(F.col("ratio") == name, F.col("m"))).alias(f"median_{name}")
          for name in ratios]
    )
    joined = attach(out, wide, ["age_bin", "subset"])
    # A bin without any high-confidence arc row still has a row, with n = 0.
    empty = _by_bin(df).agg(F.count_if(chosen).alias("_c")).where(F.col("_c") == 0).select(
        "age_bin", F.lit("high_9class_arc").alias("subset"), F.lit(0).cast("bigint").alias("n")
    )
    both = joined.unionByName(empty, allowMissingColumns=True)
    rest = [as_col(c) for c in both.columns if c != "age_bin"]
    return both.select(bin_text(), _mid_ga(), *rest)


def _ratio_rows(df: DataFrame, keys: Sequence[str], names) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("ratio"), as_col(n).alias("value")) for n in names
    ]))
    return df.select(*[as_col(k) for k in keys], pairs.alias("r")).select(
        *[as_col(k) for k in keys], "r.ratio", "r.value"
    )


def class_by_bin(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Class counts and row shares per age bin, absent classes as 0."""
    counted = _by_bin(df).agg(
        *[F.count_if(F.col("pred_class_name") == c).alias(f"n_{c}") for c in classes]
    )
    total = sum((F.col(f"`n_{c}`") for c in classes), F.lit(0))
    return counted.select(
        F.col("age_bin.mid").alias("age_bin_mid_ma"),
        *[as_col(f"n_{c}") for c in classes],
        *[F.try_divide(as_col(f"n_{c}"), total).alias(f"ratio_{c}") for c in classes],
    )


def summarize_cases(df: DataFrame, case: str, classes: Mapping[str, str], arc: Sequence[str]) -> DataFrame:
    """Per case: rows, arc rows and share, high-confidence rows, rows per class (short names)."""
    is_arc = F.col("pred_class_name").isin(list(arc))
    high = F.col("is_high_confidence")
    return df.groupBy(as_col(case)).agg(
        _n().alias("n_samples"),
        F.count_if(is_arc).alias("arc_related_count"),
        share(is_arc).alias("arc_related_pct"),
        F.count_if(high).alias("high_confidence_count"),
        F.count_if(high & is_arc).alias("high_confidence_arc_count"),
        *[F.count_if(F.col("pred_class_name") == c).alias(f"n_{short}")
          for c, short in classes.items()],
    )


def case_composition(df: DataFrame, case: str, arc: Sequence[str]) -> DataFrame:
    """Rows per case and class, largest first, with the arc percent of the case."""
    counts = df.groupBy(as_col(case), "pred_class_name").agg(_n().alias("n"))
    within = Window.partitionBy(as_col(case))
    arc_n = F.sum(F.when(F.col("pred_class_name").isin(list(arc)), F.col("n")).otherwise(0))
    return counts.withColumn(
        "arc_percent", F.lit(100.0) * arc_n.over(within) / F.sum("n").over(within)
    ).orderBy(as_col(case), F.desc("n"), "pred_class_name")


def component_summary(df: DataFrame, component: str = "POOL_COMPONENT") -> DataFrame:
    """Per component and overall: rows, high-arc rows and percent, those inside the domain,
    percent outside it, mean confidence.  The total row is marked ``ALL_EXPANDED``."""
    high, outside = F.col("High_arc_P_ge_0_5"), F.col("knn_outside_99")
    rolled = df.rollup(as_col(component)).agg(
        F.grouping(as_col(component)).alias("_g"),
        _n().alias("n"),
        F.count_if(high).alias("high_arc_n"),
        share(high, 100.0).alias("high_arc_pct"),
        F.count_if(high & ~outside).alias("high_arc_in_99_domain_n"),
        share(outside, 100.0).alias("knn_outside_99_pct"),
        F.avg("Prediction_confidence").alias("mean_confidence"),
    )
    name = F.when(F.col("_g") == 1, F.lit("ALL_EXPANDED")).otherwise(as_col(component))
    rest = [as_col(c) for c in rolled.columns if c not in (component, "_g")]
    return rolled.select(name.alias("component"), *rest)


# --- drift ------------------------------------------------------------------------------------


def class_drift_summary(df: DataFrame, cls: str = "current_class") -> DataFrame:
    """Eleven drift measures per predicted class."""
    main = df.groupBy(as_col(cls)).agg(
        _n().alias("n"),
        F.avg("current_confidence").alias("mean_confidence"),
        share(F.col("knn_outside_99"), 100.0).alias("knn_outside_99_pct"),
        share(F.col("mahalanobis_outside_99"), 100.0).alias("mahalanobis_outside_99_pct"),
        share(F.col("nearest_class") == as_col(cls), 100.0).alias("nearest_class_match_pct"),
        share(F.col("imputation_changed_class"), 100.0).alias("median_imputation_class_change_pct"),
        share(F.col("normalization_changed_class"), 100.0).alias("normalization_class_change_pct"),
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    main = main.withColumn("pct", F.lit(100.0) * F.col("n") / total)
    for source, name in (("missing_feature_count", "median_missing_count"),
                         ("boundary_feature_count", "median_boundary_count")):
        main = attach(main, exact_median(df, [cls], source, name), [cls])
    return main.withColumnRenamed(cls, "predicted_class").orderBy(F.desc("n"))


def source_drift_summary(
    df: DataFrame, source: str, target_class: str, min_n: int = 10, cls: str = "current_class",
    arc: str = "current_arc_probability",
) -> DataFrame:
    """Drift measures per source, sources with enough rows only (NULL is a source)."""
    main = df.groupBy(as_col(source)).agg(
        _n().alias("n"),
        share(as_col(cls) == target_class, 100.0).alias("cfb_pct"),
        share(as_col(arc) >= 0.5, 100.0).alias("arc_ge_0_5_pct"),
        F.avg("current_confidence").alias("mean_confidence"),
    ).where(F.col("n") >= min_n)
    for value, name in (("missing_feature_count", "median_missing_count"),
                        ("knn_distance", "median_knn_distance")):
        main = attach(main, exact_median(df, [source], value, name), [source])
    return main.withColumnRenamed(source, "source").orderBy(F.desc("n"))


def counterfactual_summary(
    df: DataFrame, variants: Sequence[str], target_class: str, current: str = "current"
) -> DataFrame:
    """Per variant: rows and percent of a class, arc rows, mean and median confidence, agreement
    with the current class."""
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(v).alias("variant"), as_col(f"{v}_class").alias("class"),
            as_col(f"{v}_confidence").alias("confidence"),
            as_col(f"{v}_arc_probability").alias("arc"),
            (as_col(f"{v}_class") == as_col(f"{current}_class")).alias("same"),
        )
        for v in variants
    ]))
    long = df.select(rows.alias("v")).select("v.*")
    hit = F.col("class") == target_class
    main = long.groupBy("variant").agg(
        F.count_if(hit).alias("cfb_n"),
        share(hit, 100.0).alias("cfb_pct"),
        F.count_if(F.col("arc") >= 0.5).alias("arc_probability_ge_0_5_n"),
        F.avg("confidence").alias("mean_confidence"),
        share(F.col("same"), 100.0).alias("class_agreement_with_current_pct"),
    )
    return attach(main, exact_median(long, ["variant"], "confidence", "median_confidence"), ["variant"])


def share_by_missing(
    df: DataFrame, count: str, flag: Column, edges: Sequence[int] = (-1, 0, 5, 10, 15, 19)
) -> DataFrame:
    """Percent of flagged rows per bin of missing cells, bins open on the left; the last has no end."""
    label = F.when(as_col(count) > edges[-1], F.lit(f"({edges[-1]}, inf)"))
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = (as_col(count) > lo) & (as_col(count) <= hi)
        label = F.when(inside, F.lit(f"({lo}, {hi}]")).otherwise(label)
    rows = df.withColumn("missing_bin", label).where(F.col("missing_bin").isNotNull())
    return rows.groupBy("missing_bin").agg(_n().alias("n"), share(flag, 100.0).alias("pct"))


# --- distributions ----------------------------------------------------------------------------


def ratio_summary(
    df: DataFrame, dataset: str, ratios: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Positive ratios per dataset: count, median, quartiles, range."""
    rows = df.select(
        as_col(dataset).alias("dataset"),
        *[ratio_pos(n, d).alias(name) for name, (n, d) in ratios.items()],
    )
    long = _ratio_rows(rows, ["dataset"], ratios).where(F.col("value") > 0)
    quart = exact_quantiles(long, ["dataset", "ratio"], "value", [0.0, 0.25, 0.5, 0.75, 1.0])
    at = lambda i: F.get("q", i)
    return quart.select(
        "dataset", "ratio", F.col("n").alias("n_positive"), at(2).alias("median"),
        at(1).alias("q25"), at(3).alias("q75"), at(0).alias("min"), at(4).alias("max"),
    )


def box_stats(
    df: DataFrame, label: str, elements: Mapping[str, str], cap: float = 0.998
) -> DataFrame:
    """Box-plot numbers per class and element (P2, quartiles, P98) and the element's cap.

    ``elements`` maps a column to its axis, ``log`` or ``linear``; non-positive values are left
    out on log axes.
    """
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("element"),
            (F.when(as_col(c) > 0, as_col(c)) if axis == "log" else as_col(c)).alias("value"),
        )
        for c, axis in elements.items()
    ]))
    long = df.select(as_col(label).alias("label"), cells.alias("e")).select("label", "e.*")
    boxes = exact_quantiles(long, ["element", "label"], "value", [0.02, 0.25, 0.5, 0.75, 0.98])
    caps = exact_quantiles(long, ["element"], "value", [cap]).select(
        "element", F.get("q", 0).alias("cap")
    )
    names = ["whisker_lo", "q1", "median", "q3", "whisker_hi"]
    out = boxes.select(
        "element", "label", "n", *[F.get("q", i).alias(n) for i, n in enumerate(names)]
    )
    return attach(out, caps, ["element"])


def median_centres(df: DataFrame, dataset: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Median x and y per dataset and column pair over rows with x > 0 and y >= 0."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(f"{a}|{b}").alias("pair"), as_col(a).cast("double").alias("x"),
                 as_col(b).cast("double").alias("y"))
        for a, b in pairs
    ]))
    long = df.select(as_col(dataset).alias("dataset"), cells.alias("c")).select("dataset", "c.*")
    long = long.where((F.col("x") > 0) & (F.col("y") >= 0))
    axes = F.explode(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x").alias("value")),
        F.struct(F.lit("y").alias("axis"), F.col("y").alias("value")),
    ))
    flat = long.select("dataset", "pair", axes.alias("a")).select("dataset", "pair", "a.*")
    med = exact_median(flat, ["dataset", "pair", "axis"], "value", "m")
    return med.groupBy("dataset", "pair").agg(
        F.max(F.when(F.col("axis") == "x", F.col("m"))).alias("median_x"),
        F.max(F.when(F.col("axis") == "y", F.col("m"))).alias("median_y"),
    )


# --- windows over age -------------------------------------------------------------------------


def sliding_mean(
    df: DataFrame, age: str, value: str, width: float = 200.0, step: float = 50.0,
    shift: float = 0.0, first: float = 2500.0, last: float = 4000.0, min_n: int = 5,
) -> DataFrame:
    """Mean in windows ``centre - w/2 <= age < centre + w/2``; small windows are dropped.

    Every row is sent to the few windows that contain it, so this is a plain grouping.
    """
    start = first + shift
    top = int((last - start) // step)
    lo = F.floor((as_col(age) - width / 2.0 - start) / F.lit(step)) + 1
    hi = F.floor((as_col(age) + width / 2.0 - start) / F.lit(step))
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(top))
    rows = df.where(as_col(age).isNotNull()).select(
        as_col(age), as_col(value),
        F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(
            F.array().cast("array<bigint>"))).alias("_i"),
    )
    centre = F.lit(start) + F.col("_i") * F.lit(step)
    return (
        rows.groupBy("_i")
        .agg(F.avg(as_col(value)).alias("mean_arc"), _n().alias("n"))
        .where(F.col("n") >= min_n)
        .select((centre / 1000.0).alias("age_mid_ga"), "mean_arc", "n")
    )


def fixed_bins(
    df: DataFrame, age: str, arc: str, ratio: str,
    widths: Sequence[int] = (100, 150, 200, 300), shifts: Sequence[int] = (0, 50, 100, 150),
    lo_ga: float = 2.5, hi_ga: float = 4.0,
) -> DataFrame:
    """Mean arc share and median ratio for every bin width and origin shift; bins whose middle
    is outside the range are left out."""
    oldest = df.agg(F.min(as_col(age)).alias("_min"))
    wide = attach(
        df.where(as_col(age).isNotNull()).select(
            as_col(age).alias("_age"), as_col(arc).alias("_arc"), as_col(ratio).alias("_ratio")),
        oldest, [],
    )
    combos = F.explode(F.array(*[
        F.struct(F.lit(w).alias("width"), F.lit(s).alias("shift")) for w in widths for s in shifts
    ]))
    rows = wide.select("_age", "_arc", "_ratio", "_min", combos.alias("c")).select("*", "c.*")
    start = F.floor(F.col("_min") / F.col("width")) * F.col("width") - F.col("shift")
    lo = start + F.floor((F.col("_age") - start) / F.col("width")) * F.col("width")
    rows = rows.withColumn("age_mid_ga", (lo + F.col("width") / 2.0) / 1000.0).where(
        F.col("age_mid_ga").between(lo_ga, hi_ga)
    )
    keys = ["width", "shift", "age_mid_ga"]
    out = rows.groupBy(*keys).agg(F.avg("_arc").alias("mean_arc"), _n().alias("n"))
    return attach(out, exact_median(rows, keys, "_ratio", "median_ratio"), keys)


def age_histogram(
    df: DataFrame, age: str, arc: str, lo: float = 2400.0, hi: float = 4000.0, width: float = 50.0,
    threshold: float = 0.5,
) -> DataFrame:
    """Rows and high-arc rows per bin; the last bin includes its upper edge."""
    bins = int((hi - lo) / width)
    at = F.least(F.floor((as_col(age) - lo) / F.lit(width)), F.lit(bins - 1)).cast("int")
    rows = df.where(as_col(age).between(lo, hi)).groupBy(at.alias("bin")).agg(
        _n().alias("total"), F.count_if(as_col(arc) >= threshold).alias("high_arc")
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(rows, "bin", "left").select(
        ((F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)) / 1000.0).alias("age_mid_ga"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("high_arc", F.lit(0)).alias("high_arc"),
    )


def robust_z(df: DataFrame, value: str, by: Sequence[str] = (), log: bool = False, out: str = "z") -> DataFrame:
    """(x - median)/(1.4826*MAD) over a table of bins; the population deviation stands in for a
    zero MAD, and 1 for a zero deviation.  The input is a summary, one row per bin."""
    x = F.log10(F.when(as_col(value) > 0, as_col(value))) if log else as_col(value)
    w = Window.partitionBy(*([as_col(c) for c in by] or [F.lit(0)]))
    centred = df.withColumn("_x", x).withColumn("_m", F.median("_x").over(w))
    centred = centred.withColumn("_mad", F.median(F.abs(F.col("_x") - F.col("_m"))).over(w))
    spread = F.when(F.col("_mad") > 0, F.lit(1.4826) * F.col("_mad")).otherwise(
        F.coalesce(F.nullif(F.stddev_pop("_x").over(w), F.lit(0.0)), F.lit(1.0))
    )
    return centred.withColumn(out, (F.col("_x") - F.col("_m")) / spread).drop("_x", "_m", "_mad")


# --- text, units, runs, totals ----------------------------------------------------------------


def archean_stats(raw: DataFrame, consolidated: DataFrame, age: str, prefix: str | None = None) -> DataFrame:
    """Rows and rows naming the oldest eon, before and after consolidation."""
    hit = is_archean(age, prefix)
    count = lambda df, name: df.agg(
        _n().alias(f"{name}_rows"), F.count_if(hit).alias(f"{name}_age_text_archean_rows"))
    return attach(count(raw, "raw"), count(consolidated, "consolidated"), [])


_ALL = 2147483647  # no limit


def build_units(
    df: DataFrame, specs: Mapping[str, tuple[str, int | None, int | None]], source: str = "SOURCE_DATASET",
    region: str = "Craton",
) -> DataFrame:
    """Evidence per (source, region): rows and the most frequent cleaned texts of some columns.

    ``specs`` maps an output column to (input column, how many texts, text length); None keeps all
    texts, or whole ones.  Ties go by text.  Texts are counted first; ranking sees distinct texts
    only, and is limited inside the aggregation.
    """
    present = {o: s for o, s in specs.items() if s[0] in df.columns}
    keyed = df.select(
        clean_text(source).alias("SOURCE_DATASET"),
        or_unresolved(clean_text(region)).alias("current_craton"),
        *[clean_text(s[0]).alias(o) for o, s in present.items()],
    )
    keys = ["SOURCE_DATASET", "current_craton"]
    units = keyed.groupBy(*keys).agg(_n().alias("n_samples"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(o).alias("kind"), F.col(o).alias("text"), F.lit(_ALL if s[1] is None else s[1]).alias("top"),
                 F.lit(_ALL if s[2] is None else s[2]).alias("width"))
        for o, s in present.items()
    ]))
    texts = (
        keyed.select(*keys, cells.alias("c")).select(*keys, "c.*").where(F.col("text") != "")
        .groupBy(*keys, "kind", "text", "top", "width").agg(_n().alias("c"))
    )
    # Two steps, so that a unit with very many distinct texts is ranked in parts first.
    part = Window.partitionBy(*keys, "kind", F.pmod(F.xxhash64("text"), F.lit(32)))
    whole = Window.partitionBy(*keys, "kind")
    order = [F.desc("c"), F.asc("text")]
    best = texts.withColumn("_p", F.row_number().over(part.orderBy(*order))).where("_p <= top")
    best = best.withColumn("_r", F.row_number().over(whole.orderBy(*order))).where("_r <= top")
    lists = best.groupBy(*keys).agg(*[
        F.transform(
            F.array_sort(F.collect_list(F.when(
                F.col("kind") == o,
                F.struct("_r", F.expr("substring(text, 1, width)").alias("text"))))),
            lambda s: s["text"],
        ).alias(o)
        for o in present
    ])
    joined = attach(units, lists, keys)
    none = F.array().cast("array<string>")
    return joined.select(
        unit_key("SOURCE_DATASET", "current_craton").alias("unit_id"), *keys, "n_samples",
        *[(F.coalesce(F.col(o), none) if o in present else none).alias(o) for o in specs],
    )


METRICS = ["accuracy", "precision", "recall", "weighted_f1", "macro_f1", "mAP",
           "validation_loss", "best_epoch"]


def summarize_runs(df: DataFrame, by: str = "experiment", metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and sample deviation of metrics over folds and seeds."""
    return df.groupBy(as_col(by)).agg(
        *[F.avg(as_col(m)).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(as_col(m)).alias(f"{m}_std") for m in metrics],
    )


def best_run(df: DataFrame, by: str = "experiment", score: str = "accuracy", order: str = "seed_no") -> DataFrame:
    """The run with the best score per experiment, the earlier one on ties."""
    rest = [c for c in df.columns if c != by]
    best = df.groupBy(as_col(by)).agg(
        F.min(F.struct((-as_col(score)).alias("_s"), as_col(order).alias("_o"),
                       F.struct(*[as_col(c) for c in rest]).alias("_row"))).alias("_b")
    )
    return best.select(as_col(by), "_b._row.*")


def report_totals(df: DataFrame) -> DataFrame:
    """Totals of a scored table in one row."""
    high, arc, base = F.col("is_high_confidence"), F.col("is_arc_related_9class"), F.col("liu_arc_binary")
    return df.agg(
        _n().alias("n"),
        F.count_if(high).alias("n_high"),
        F.count_if(high & arc).alias("n_arc_high"),
        F.count(base).alias("n_liu_samples"),
        F.count_if(base).alias("n_liu_arc"),
        part_of(base, base.isNotNull()).alias("ratio_liu_arc"),
    )


def label_crosscheck(df: DataFrame, label: str, labels: Sequence[str], flag: str) -> DataFrame:
    """Rows and flagged rows of some original labels."""
    return df.where(as_col(label).isin(list(labels))).groupBy(as_col(label)).agg(
        _n().alias("n"), F.count_if(as_col(flag)).alias("high_arc_n")
    )


def top_k(df: DataFrame, value: str, k: int, by: Sequence[str] = (), tie: str = "feature") -> DataFrame:
    """The k largest rows, overall or per group; ties by name.  Adds ``rank``.

    The input is a table of scores (features, or class and feature), not of samples.
    """
    w = Window.partitionBy(*([as_col(c) for c in by] or [F.lit(0)])).orderBy(
        as_col(value).desc(), as_col(tie)
    )
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def order_by_group(df: DataFrame, feature: str, value: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Re-sort a ranking by feature group, then by falling value.  Adds group and its rank."""
    rank, name = F.lit(len(groups)), F.lit(None).cast("string")
    for i, (g, members) in enumerate(groups.items()):
        inside = as_col(feature).isin(list(members))
        rank = F.when(inside, F.lit(i)).otherwise(rank)
        name = F.when(inside, F.lit(g)).otherwise(name)
    return df.withColumns({"group": name, "group_rank": rank}).orderBy(
        "group_rank", F.desc(value), feature
    )


