"""Gating, pooling and scoring of application rows, and the reports on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import as_col, midpoint, resolve_age, to_number
from ..functions.text import canonical_label, craton_from_location, is_archean
from ..operators import domain as D
from ..operators import neighbours as NN
from ..operators import summaries as G
from ..operators import uncertainty as U
from ..operators.composition import anhydrous, calculate_feot, fingerprint, log_standardize, tag_component
from ..operators.dedup import attach_mask, cross_duplicates, dedup_fingerprint, internal_duplicates, union_all
from ..operators.encode import boundary_share, missing_mask, quantile_encode
from ..operators.filters import CaseArea, application_filter, drop_all_missing, exclude_record, locate_case
from ..operators.impute import ForestImputer, impute, median_impute
from ..operators.ordering import attach
from ..operators.sampling import undersample
from ..operators.schema import expect_rows, extract_features
from ..operators.score import add_prediction_columns, model_vector, prediction_frame, score
from ..session import cut_lineage, store_rows, wide_plans  # cut_lineage: also for the registry


def gate(
    df: DataFrame, keep: Sequence[str], sio2_max: float = 53.0, expected: int | None = None
) -> DataFrame:
    """Features under short names, the application gate, closed majors; optional row contract."""
    wide_plans(df.sparkSession)
    gated = application_filter(extract_features(df, keep), sio2_max=sio2_max)
    return gated if expected is None else expect_rows(gated, expected)


def gate_cases(
    df: DataFrame, areas: Sequence[CaseArea], keep: Sequence[str], sio2_max: float = 53.0
) -> DataFrame:
    """Every area located and gated, stacked with its label in ``case_label``."""
    return union_all(*[
        gate(locate_case(df, a), keep, sio2_max).withColumn("case_label", F.lit(a.label)) for a in areas
    ])


def expanded_pool(
    first: DataFrame, second: DataFrame, id_col: str = "sample_id", sio2_max: float = 54.0
) -> tuple[DataFrame, DataFrame]:
    """Pool of both sources without identical compositions, first source preferred.

    ``first`` has short names; ``second`` long names with age text, location and bounds of the
    coordinates.  Gives the pool and a one-row table of duplicate counts.
    """
    a_keep = [c for c in first.columns if c not in K.SHORT_FEATURES]
    a = gate(first, a_keep, sio2_max)
    a = tag_component(a, "SIO2", "first", "first_SiO2_le_53", "first_SiO2_53_to_54")
    b = calculate_feot(second).where(is_archean("AGE"))
    b = b.withColumns({
        "Craton": craton_from_location("LOCATION"),
        "LATITUDE": midpoint(to_number("LATITUDE MIN"), to_number("LATITUDE MAX")),
        "LONGITUDE": midpoint(to_number("LONGITUDE MIN"), to_number("LONGITUDE MAX")),
        "SOURCE_AGE_TEXT": as_col("AGE"), "SOURCE_LOCATION": as_col("LOCATION"),
        "SOURCE_ORIGINAL_TECTONIC_LABEL": as_col("TECTONIC SETTING"),
    })
    b = gate(b, [id_col, "Craton", "LATITUDE", "LONGITUDE", "SOURCE_AGE_TEXT", "SOURCE_LOCATION",
                 "SOURCE_ORIGINAL_TECTONIC_LABEL"], sio2_max)
    b = b.withColumns({"SOURCE_DATASET": F.lit("second"), "POOL_COMPONENT": F.lit("second_recovered")})
    key = fingerprint(K.SHORT_FEATURES, short=True)
    both = union_all(a.withColumn("_rank", F.lit(0)), b.withColumn("_rank", F.lit(1)))
    both = store_rows(both.withColumn("_key", key))
    pool = dedup_fingerprint(both, "_key", ["_rank", id_col])
    sides = [both.where(F.col("_rank") == r).select("_key") for r in (0, 1)]
    stats = pool.agg(F.sum(F.col("copies") - 1).alias("removed"), F.count(F.lit(1)).alias("pool_rows"))
    for name, side in zip(("first_internal", "second_internal"), sides):
        stats = attach(stats, internal_duplicates(side, "_key").select(
            F.coalesce("n_duplicates", F.lit(0)).alias(name)), [])
    cross = cross_duplicates(sides[0], sides[1], "_key").agg(F.count(F.lit(1)).alias("cross_source"))
    return pool.drop("_key", "_rank", "copies"), attach(stats, cross, [])


def encode_and_score(
    df: DataFrame, cols: Sequence[str], bounds: Mapping, models: Sequence, id_col: str,
    mask: DataFrame | None = None, on_null: str = "zero",
) -> DataFrame:
    """Quantile codes, mask and class probabilities of continuous rows."""
    if mask is None:  # the rows' own flags stay beside them
        coded = quantile_encode(missing_mask(df, cols, keep=df.columns), bounds, on_null)
    else:
        coded = attach_mask(quantile_encode(df, bounds, on_null), mask, id_col)
    return score(model_vector(coded, cols), models)


def pool_report(
    pool: DataFrame, reference: DataFrame, cols: Sequence[str], majors: Sequence[str],
    imputer: ForestImputer, bounds: Mapping, models: Sequence, class_names: Sequence[str],
    arc: Sequence[str], id_col: str = "sample_id", component: str = "POOL_COMPONENT", k: int = 10,
) -> DataFrame:
    """Impute, close, encode and score the pool; neighbour distance to the reference; summary by
    component."""
    mask = missing_mask(pool, cols, "null_or_nonpositive", [id_col])
    filled = store_rows(anhydrous(impute(pool, imputer), majors, "observed"))
    scored = encode_and_score(filled, cols, bounds, models, id_col, mask)
    predicted = prediction_frame(scored, "probs", class_names, id_col, arc)
    ref_d, app_d, _ = domain_distances(reference, filled, cols, id_col, k)
    rows = (
        filled.select(as_col(id_col), as_col(component)).hint("merge").join(predicted, id_col)
        .join(attach(app_d, D.distance_thresholds(ref_d), []), id_col)
    )
    rows = rows.withColumns({
        "High_arc_P_ge_0_5": F.col("high_arc"), "Prediction_confidence": F.col("confidence"),
        "knn_outside_99": F.col("knn_distance") > F.col("q99"),
    })
    return G.component_summary(rows, component)


def domain_distances(
    ref: DataFrame, app: DataFrame, cols: Sequence[str], id_col: str, k: int = 10,
    k_app: int | None = None, mode: str = "clip", share: float = 0.85,
) -> tuple[DataFrame, DataFrame, tuple]:
    """Neighbour distances in whitened principal components of standardised log10 values.

    Third result: the component model and both tables with their coordinates.
    """
    x_ref, x_app = log_standardize(ref, app, cols, mode)
    as_vec = lambda t: t.withColumn("vec", F.array(*[as_col(c) for c in cols]))
    # Everything below reads these rows several times: moments, components, pivots, cells, queries.
    x_ref, x_app = store_rows(as_vec(x_ref)), store_rows(as_vec(x_app))
    pca = D.fit_pca(x_ref, "vec")
    n = pca.n_for(share)
    p_ref, p_app = D.project(x_ref, pca, "vec", n), D.project(x_app, pca, "vec", n)
    w_ref, w_app = D.whiten(p_ref, [p_app], "pcs")
    ref_d, app_d = NN.knn_distance(w_ref, w_app, id_col, "pcs", k, k_app)
    return ref_d, app_d, (pca, p_ref, p_app, w_ref, w_app)


def score_application(
    df: DataFrame, cols: Sequence[str], majors: Sequence[str], bounds: Mapping, models: Sequence,
    class_names: Sequence[str], arc: Sequence[str], age: Sequence[str] = ("C_AGE", "AGE"),
    width: float = 200.0, id_col: str = "sample_id", baseline: str | None = None,
    max_missing: int | None = None, high_p: float = 0.5,
) -> DataFrame:
    """Gated rows to a scored, age-binned table: missing cells keep code 0 and their mask."""
    raw = df.withColumns({"_raw_" + c: as_col(c) for c in cols})
    kept = anhydrous(drop_all_missing(raw, cols, max_missing), majors, "observed")
    scored = encode_and_score(kept, cols, bounds, models, id_col)
    out = add_prediction_columns(
        scored, "probs", class_names, "probs_std", arc, high_p=high_p, baseline=baseline
    ).drop("features", *[f"missing_mask__{c}" for c in cols])
    out = out.withColumns({c: as_col("_raw_" + c) for c in cols}).drop(*["_raw_" + c for c in cols])
    return G.add_age_bins(out, resolve_age(age, out.columns), width)


def drift_report(
    ref_raw: DataFrame, ref: DataFrame, app_raw: DataFrame, app_filled: DataFrame,
    cols: Sequence[str], majors: Sequence[str], bounds: Mapping, models: Sequence,
    class_names: Sequence[str], arc: Sequence[str], label: str, target_class: str,
    source: str | None = None, id_col: str = "sample_id", k: int = 10, k_app: int = 11,
    min_source_rows: int = 10,
) -> dict[str, DataFrame]:
    """Element, correlation, sample, class, source and variant tables of a drift study.

    ``ref`` and ``app_filled`` are complete; the variants replace the imputation by reference
    medians, and skip the closure.
    """
    closed = store_rows(anhydrous(app_filled, majors, "domain"))
    median = anhydrous(median_impute(ref_raw, app_raw, cols), majors, "domain")
    mask = missing_mask(app_raw, cols, "null_or_nonpositive", [id_col])
    variants = {"current": closed, "median_impute": median, "no_major_normalization": app_filled}
    predicted = {
        name: prediction_frame(
            encode_and_score(t, cols, bounds, models, id_col, mask), "probs", class_names, id_col, arc)
        for name, t in variants.items()
    }
    codes = quantile_encode(closed, bounds, "error")
    ref_d, app_d, (_, _, _, w_ref, w_app) = domain_distances(ref, closed, cols, id_col, k, k_app)
    shape, thresholds = D.mahalanobis(w_ref, w_app, "pcs", label, id_col)
    near = attach(app_d, D.distance_thresholds(ref_d), [])
    distances = near.select(
        as_col(id_col), "knn_distance", (F.col("knn_distance") > F.col("q95")).alias("knn_outside_95"),
        (F.col("knn_distance") > F.col("q99")).alias("knn_outside_99"),
    ).join(shape.hint("merge"), id_col)
    flags = mask.select(
        as_col(id_col),
        sum((as_col(f"missing_mask__{c}").cast("int") for c in cols), F.lit(0)).alias("missing_feature_count"))
    counts = flags.join(boundary_share(codes, cols, "row", id_col=id_col), id_col)
    sample = D.sample_diagnostics(predicted, distances, counts, id_col)
    if source is not None:
        sample = sample.join(app_raw.select(as_col(id_col), as_col(source)), id_col)
    sample = store_rows(sample)
    out = {
        "element": D.element_summary(ref_raw, ref, app_raw, closed, codes, cols),
        "correlation": D.correlation_shift(ref, closed, app_raw, cols),
        "sample": sample,
        "thresholds": attach(thresholds, D.distance_thresholds(ref_d).withColumnsRenamed(
            {"q95": "knn_q95", "q99": "knn_q99"}), []),
        "class": G.class_drift_summary(sample),
        "variant": G.counterfactual_summary(sample, list(variants), target_class),
    }
    if source is not None:
        out["source"] = G.source_drift_summary(sample, source, target_class, min_source_rows)
    return out


def domain_coverage(
    ref: DataFrame, app: DataFrame, cols: Sequence[str], label: str, arc: str,
    cap_label: str | None = None, cap: int = 6920, id_col: str = "sample_id", k: int = 10,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Canonical labels, one label undersampled, component space, coverage, ellipses, loadings."""
    ref = ref.withColumn(label, canonical_label(label)).where(as_col(label).isNotNull())
    if cap_label is not None:
        ref = undersample(ref, label, cap_label, cap, seed, id_col)
    ref_d, app_d, (pca, p_ref, p_app, _, _) = domain_distances(ref, app, cols, id_col, k, mode="mask")
    axes = {"PC1": F.get("pcs", 0), "PC2": F.get("pcs", 1)}
    near = app_d.join(app.select(as_col(id_col), as_col(arc).alias("_arc")), id_col)
    return {
        "coverage": D.coverage(near, D.distance_thresholds(ref_d), "knn_distance", "_arc"),
        "histogram": D.distance_histogram(app_d, D.distance_thresholds(ref_d), "knn_distance"),
        "ellipses": D.ellipse_overlap(p_ref.withColumns(axes), p_app.withColumns(axes), label, "PC1", "PC2", arc),
        "loadings": D.loadings(pca, cols, ref.sparkSession),
    }


def age_evidence(
    df: DataFrame, classes: Sequence[str], ratios: Mapping[str, tuple[str, str]], id_col: str,
    age: Sequence[str] = ("C_AGE", "AGE"), bad_record: Column | None = None, width: float = 200.0,
    threshold: float = 0.5, reps: int = 2000, seed: int = 20240611, from_mid: float = 2500.0,
) -> dict[str, DataFrame]:
    """Age-bin tables of a scored table: summary, shares, weighted ratios with intervals and
    robust scores, proportions with intervals, fine histogram, bin-width sensitivity."""
    if bad_record is not None:
        df = exclude_record(df, bad_record)
    df = G.add_age_bins(df.withColumn("_age", resolve_age(age, df.columns)), "_age", width)
    positive = lambda c: F.when(as_col(c) > 0, as_col(c))
    cells = F.explode(F.array(*[
        F.struct(F.lit(name).alias("ratio"), F.try_divide(positive(n), positive(d)).alias("value"))
        for name, (n, d) in ratios.items()
    ]))
    late = df.where(F.col("age_bin.mid") >= from_mid)
    rows = late.select(
        as_col(id_col), (F.col("age_bin.mid") / 1000.0).alias("age_mid_ga"),
        F.greatest("Arc_probability3", F.lit(0.0)).alias("weight"), cells.alias("c"),
    ).select(as_col(id_col), "age_mid_ga", "weight", "c.*")
    ratio_stats = U.weighted_bootstrap(
        rows, ["ratio", "age_mid_ga"], "value", "weight", reps, seed, id_col)
    ratio_stats = G.robust_z(G.robust_z(ratio_stats, "weighted_mean", ["ratio"]), "weighted_mean", ["ratio"], True, "z_log")
    first = next(iter(ratios.values()))
    return {
        "summary": G.summarize_by_age(df, classes),
        "shares": G.arc_ratio(df, [threshold]),
        "ratios": ratio_stats,
        "proportions": U.proportion_ci(
            late.withColumn("age_mid_ga", F.col("age_bin.mid") / 1000.0), ["age_mid_ga"],
            F.col("Arc_probability3") >= threshold),
        "histogram": G.age_histogram(df, "_age", "Arc_probability3", threshold=threshold),
        "sensitivity": G.fixed_bins(
            df.withColumn("_r", F.try_divide(as_col(first[0]), as_col(first[1]))), "_age", "Arc_probability3", "_r"),
        "sliding": G.sliding_mean(df, "_age", "Arc_probability3", width),
    }


