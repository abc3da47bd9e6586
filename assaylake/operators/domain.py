"""Distribution drift and applicability domain."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import as_col, log10_clipped, log10_positive, missing
from ..session import cut_lineage
from .filters import unpivot
from .ordering import attach, exact_median, exact_quantiles, prefix_sums


# --- distributions ----------------------------------------------------------------------------


def ks_two_sample(df: DataFrame, group: str, reference, cols: Sequence[str]) -> DataFrame:
    """Largest gap between two empirical distribution functions per feature, on log10 values.

    Rows with ``group == reference`` are one sample, all other rows the second.
    """
    long = unpivot(df, [group], cols).withColumn("log", log10_positive("value"))
    curves = prefix_sums(
        long, ["feature"], "log",
        {
            "ref": F.when(as_col(group) == reference, 1).otherwise(0),
            "app": F.when(as_col(group) == reference, 0).otherwise(1),
        },
    )
    gap = F.abs(
        F.try_divide("cum_ref", "total_ref") - F.try_divide("cum_app", "total_app")
    )
    return curves.groupBy("feature").agg(F.max(gap).alias("ks"))


def element_summary(
    ref_raw: DataFrame, ref: DataFrame, app_raw: DataFrame, app: DataFrame, app_codes: DataFrame,
    cols: Sequence[str], codes: int = 255,
) -> DataFrame:
    """Per feature: missing percent, medians, median log shift, distribution gap and percent of
    edge codes.  The inputs share feature names: raw and continuous reference, raw, continuous
    and encoded application table."""
    def shares(df: DataFrame, flags: Mapping[str, object]) -> DataFrame:
        counted = df.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count_if(f(c)).alias(f"_{n}_{i}")
              for n, f in flags.items() for i, c in enumerate(cols)],
        )
        rows = F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"),
                     *[(F.lit(100.0) * F.col(f"_{n}_{i}") / F.col("_n")).alias(n) for n in flags])
            for i, c in enumerate(cols)
        ]))
        return counted.select("_n", rows.alias("_f")).select("_f.*")

    tagged = ref.select(F.lit("ref").alias("_g"), *[as_col(c) for c in cols]).unionByName(
        app.select(F.lit("app").alias("_g"), *[as_col(c) for c in cols])
    )
    positive = unpivot(tagged, ["_g"], cols).where((F.col("value") > 0) & (F.col("value") < float("inf")))
    medians = exact_median(positive, ["feature", "_g"], "value", "m").groupBy("feature").agg(
        F.max(F.when(F.col("_g") == "ref", F.col("m"))).alias("ref_median"),
        F.max(F.when(F.col("_g") == "app", F.col("m"))).alias("app_median"),
    )
    parts = [
        shares(ref_raw, {"ref_missing_pct": lambda c: as_col(c).isNull()}),
        shares(app_raw, {"app_missing_or_nonpositive_pct":
                         lambda c: missing(c, "null_or_nonpositive")}),
        shares(app_codes, {"app_bin_1_pct": lambda c: as_col(c) == 1,
                           f"app_bin_{codes}_pct": lambda c: as_col(c) == codes,
                           "app_boundary_pct": lambda c: as_col(c).isin(1, codes)}),
        ks_two_sample(tagged, "_g", "ref", cols).withColumnRenamed("ks", "log10_ks_statistic"),
    ]
    out = medians.withColumn(
        "median_log10_shift", F.log10("app_median") - F.log10("ref_median")
    )
    for part in parts:
        out = out.join(part, "feature")
    return out.withColumn("app_imputed_pct", F.col("app_missing_or_nonpositive_pct")).orderBy(
        F.desc("log10_ks_statistic"), "feature"
    )


# --- correlation ------------------------------------------------------------------------------


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float]:
    """Rank correlations of complete columns; a matrix of features, not of rows.

    Equal rows are counted together, average ranks come from running counts per column and are joined
    by value, and one aggregation gives the sums of all pairs.  NaN ranks last; a constant column gives NaN.
    """
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return {}
    logs = [F.nanvl(log10_clipped(c), F.lit(float("inf"))).alias(f"_x{i}") for i, c in enumerate(cols)]
    names = [f"_x{i}" for i in range(len(cols))]
    cells = cut_lineage(df.select(*logs).groupBy(*names).agg(F.count(F.lit(1)).alias("_w")))
    long = unpivot(cells, ["_w"], names)
    runs = prefix_sums(long, ["feature"], "value", {"c": F.col("_w")})
    ranks = cut_lineage(runs.select(
        "feature", "value",
        (F.col("cum_c") - (F.col("c") - 1) / 2.0 - (F.col("total_c") + 1) / 2.0).alias("_r"),
    ))
    for i, name in enumerate(names):
        own = ranks.where(F.col("feature") == name).select(F.col("value").alias(name), F.col("_r").alias(f"_r{i}"))
        cells = cells.join(own, name)
    total = lambda i, j: F.sum(F.col("_w") * F.col(f"_r{i}") * F.col(f"_r{j}"))
    row = cells.agg(
        *[total(i, i).alias(f"s{i}") for i in range(len(cols))],
        *[total(i, j).alias(f"s{i}_{j}") for i, j in pairs],
    ).first()
    spread = [np.sqrt(row[f"s{i}"] or 0.0) for i in range(len(cols))]
    return {
        (cols[i], cols[j]): float(row[f"s{i}_{j}"] / (spread[i] * spread[j])) if spread[i] * spread[j] else float("nan")
        for i, j in pairs
    }


def observed_spearman(
    df: DataFrame, cols: Sequence[str], min_n: int = 30, policy: str = "null_or_nonpositive"
) -> DataFrame:
    """Rank correlation of every feature pair over rows where both are observed.

    Rows are first counted per distinct pair of values; average ranks come from running counts
    per pair, and the mean rank is known, so one weighted sum gives the correlation.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    struct = [
        F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"),
                 as_col(a).cast("double").alias("x"), as_col(b).cast("double").alias("y"))
        for a, b in pairs
    ]
    long = df.select(F.explode(F.array(*struct)).alias("p")).select("p.*").where(
        ~missing("x", policy) & ~missing("y", policy)
    )
    cells = long.groupBy("f1", "f2", "x", "y").agg(F.count(F.lit(1)).alias("w"))

    def ranks(axis: str) -> DataFrame:
        runs = prefix_sums(cells, ["f1", "f2"], axis, {"c": F.col("w")})
        return runs.select(
            "f1", "f2", axis,
            (F.col("cum_c") - (F.col("c") - 1) / 2.0 - (F.col("total_c") + 1) / 2.0).alias("r" + axis),
        )

    ranked = cells.join(ranks("x"), ["f1", "f2", "x"]).join(ranks("y"), ["f1", "f2", "y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    rho = F.try_divide(
        F.sum(w * rx * ry), F.sqrt(F.sum(w * rx * rx)) * F.sqrt(F.sum(w * ry * ry))
    )
    out = ranked.groupBy("f1", "f2").agg(F.sum("w").alias("n"), rho.alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))


def correlation_shift(
    ref: DataFrame, app: DataFrame, app_raw: DataFrame, cols: Sequence[str], min_n: int = 30
) -> DataFrame:
    """Rank correlation of every feature pair in the reference, the filled application table and
    its observed cells, with the absolute changes, largest shift first."""
    spark = ref.sparkSession
    a, b = spearman_matrix(ref, cols), spearman_matrix(app, cols)
    full = spark.createDataFrame(
        [(f1, f2, a[f1, f2], b[f1, f2]) for f1, f2 in a],
        "f1 string, f2 string, reference_spearman double, imputed_spearman double",
    )
    seen = observed_spearman(app_raw, cols, min_n)
    return (
        full.join(seen, ["f1", "f2"], "left")
        .select(
            F.col("f1").alias("element_1"), F.col("f2").alias("element_2"),
            "reference_spearman", "imputed_spearman",
            F.col("rho").alias("observed_spearman"),
            F.coalesce("n", F.lit(0)).alias("observed_pair_n"),
            F.abs(F.col("imputed_spearman") - F.col("reference_spearman")).alias(
                "imputed_vs_reference_abs_delta"),
            F.abs(F.col("imputed_spearman") - F.col("rho")).alias("imputation_correlation_change"),
        )
        .orderBy(F.desc("imputed_vs_reference_abs_delta"), "element_1", "element_2")
    )


# --- principal components ---------------------------------------------------------------------


@dataclass(frozen=True)
class PcaModel:
    """Mean, components (rows) with the largest loading positive, variance shares."""

    mean: np.ndarray
    components: np.ndarray
    ratio: np.ndarray
    model: object

    def n_for(self, share: float = 0.85, least: int = 2) -> int:
        """First number of components explaining the wanted share of variance."""
        cut = int(np.searchsorted(np.cumsum(self.ratio), share) + 1)
        return max(least, min(cut, len(self.ratio)))


def _as_doubles(vec: str):
    return F.transform(as_col(vec), lambda x: x.cast("double"))


def fit_pca(ref: DataFrame, vec: str) -> PcaModel:
    """Full PCA of an array column; the covariance is accumulated in the cluster."""
    width = ref.select(F.size(as_col(vec))).first()[0]
    moments = _moments(ref, vec, None)
    mean = moments["_all"].mean
    centred = ref.select(_centred(vec, mean).alias("_c"))
    model = PCA(k=width, inputCol="_c", outputCol="_p").fit(centred)
    parts = model.pc.toArray().T
    strongest = parts[np.arange(width), np.abs(parts).argmax(axis=1)]
    parts = parts * np.where(strongest < 0, -1.0, 1.0)[:, None]
    return PcaModel(mean, parts, model.explainedVariance.toArray(), model)


def _centred(vec: str, mean: np.ndarray):
    middle = F.array(*[F.lit(float(m)) for m in mean])
    return array_to_vector(F.zip_with(_as_doubles(vec), middle, lambda x, m: x - m))


def project(df: DataFrame, pca: PcaModel, vec: str, n: int, out: str = "pcs") -> DataFrame:
    """Coordinates on the first n components as an array column."""
    signs = np.sign((pca.components * pca.model.pc.toArray().T).sum(axis=1))
    flip = F.array(*[F.lit(float(s)) for s in signs[:n]])
    done = pca.model.transform(df.withColumn("_c", _centred(vec, pca.mean)))
    coords = F.slice(vector_to_array("_p"), 1, n)
    return done.withColumn(out, F.zip_with(coords, flip, lambda x, s: x * s)).drop("_c", "_p")


def whiten(ref: DataFrame, others: Sequence[DataFrame], pcs: str) -> list[DataFrame]:
    """Coordinates over the reference deviation (population; 0 counts as 1), all tables."""
    sd = _moments(ref, pcs, None)["_all"]
    spread = np.sqrt(np.diag(sd.cov))
    spread[spread == 0] = 1.0
    scale = F.array(*[F.lit(float(s)) for s in spread])
    return [
        df.withColumn(pcs, F.zip_with(as_col(pcs), scale, lambda x, s: x / s))
        for df in [ref, *others]
    ]


def loadings(pca: PcaModel, names: Sequence[str], spark) -> DataFrame:
    """Loadings on the first two components, by absolute loading on the first."""
    rows = [
        (name, float(a), float(b), abs(float(a)), abs(float(b)))
        for name, a, b in zip(names, pca.components[0], pca.components[1])
    ]
    return spark.createDataFrame(
        rows, "feature string, PC1_loading double, PC2_loading double, PC1_abs double, PC2_abs double"
    ).orderBy(F.desc("PC1_abs"), "feature")


# --- Mahalanobis with shrinkage ---------------------------------------------------------------


@dataclass(frozen=True)
class Moments:
    """Count, mean, population covariance and the sum of fourth powers of centred lengths."""

    n: int
    mean: np.ndarray
    cov: np.ndarray
    fourth: float

    def shrunk_precision(self) -> np.ndarray:
        """Inverse of the covariance shrunk towards a scaled identity (Ledoit and Wolf 2004)."""
        p = len(self.mean)
        mu = np.trace(self.cov) / p
        if p == 1:
            return np.linalg.pinv(self.cov)
        spread = (self.cov**2).sum()
        distance = (spread - 2 * mu * np.trace(self.cov) + p * mu**2) / p
        noise = (self.fourth / self.n - spread) / (p * self.n)
        noise = min(noise, distance)
        weight = 0.0 if noise == 0 else noise / distance
        shrunk = (1 - weight) * self.cov
        shrunk.flat[:: p + 1] += weight * mu
        return np.linalg.pinv(shrunk)


def _moments(df: DataFrame, vec: str, label: str | None) -> dict[str, Moments]:
    """Moments per label (and of all rows as ``_all`` when no label is given).

    Batches are reduced to sums inside the tasks; what reaches the driver is one small matrix
    per label.  Two passes, so that the second-order sums are taken around the mean.
    """
    key = as_col(label).cast("string") if label else F.lit("_all")
    rows = df.select(key.alias("k"), _as_doubles(vec).alias("v"))

    def sums(means: Mapping[str, np.ndarray] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc: dict[str, np.ndarray] = {}
            for pdf in batches:
                for k, part in pdf.groupby("k"):
                    x = np.stack(part["v"].to_numpy()).astype(float)
                    if means is None:
                        flat = np.concatenate([[len(x)], x.sum(axis=0)])
                    else:
                        x = x - means[k]
                        squares = (x**2).sum(axis=1)
                        flat = np.concatenate([[(squares**2).sum()], (x.T @ x).ravel()])
                    acc[k] = acc[k] + flat if k in acc else flat
            for k, flat in acc.items():
                yield pd.DataFrame({"k": k, "i": np.arange(len(flat)), "s": flat})

        return run

    def gather(means=None) -> dict[str, np.ndarray]:
        parts = rows.mapInPandas(sums(means), "k string, i int, s double")
        table = parts.groupBy("k", "i").agg(F.sum("s").alias("s")).toPandas()
        return {k: g.sort_values("i")["s"].to_numpy() for k, g in table.groupby("k")}

    first = gather()
    means = {k: s[1:] / s[0] for k, s in first.items()}
    second = gather(means)
    out = {}
    for k, s in second.items():
        n, p = int(first[k][0]), len(means[k])
        out[k] = Moments(n, means[k], s[1:].reshape(p, p) / n, float(s[0]))
    return out


def _distances(df: DataFrame, vec: str, spaces: Mapping[str, Moments]) -> DataFrame:
    """Array of distances to every space, in the order of the mapping."""
    solved = [(m.mean, m.shrunk_precision()) for m in spaces.values()]

    @F.pandas_udf("array<double>")
    def measure(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        cols = []
        for mean, precision in solved:
            d = x - mean
            cols.append(np.sqrt(np.clip(((d @ precision) * d).sum(axis=1), 0, None)))
        return pd.Series(list(np.column_stack(cols)))

    return df.withColumn("_d", measure(_as_doubles(vec)))


def mahalanobis(
    ref: DataFrame, app: DataFrame, vec: str, label: str, id_col: str
) -> tuple[DataFrame, DataFrame]:
    """Distances with shrunk covariances.

    First result: application rows with the global distance, flags beyond the 95th and 99th
    percentile of the reference distances, nearest class and its distance.  Second: one row
    with both thresholds and the share of reference rows whose nearest class is their own.
    """
    whole = _moments(ref, vec, None)
    classes = _moments(ref, vec, label)
    names = list(classes)
    spaces = {**whole, **classes}

    def measured(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        wide = _distances(df, vec, spaces)
        per_class = F.slice("_d", 2, len(names))
        nearest = F.array_position(per_class, F.array_min(per_class))
        return wide.select(
            *[as_col(c) for c in keep],
            F.get("_d", 0).alias("global_mahalanobis"),
            F.element_at(F.array(*[F.lit(n) for n in names]), nearest.cast("int")).alias("nearest_class"),
            F.array_min(per_class).alias("nearest_class_mahalanobis"),
        )

    known = measured(ref, [id_col, label])
    cuts = exact_quantiles(known, [], "global_mahalanobis", [0.95, 0.99]).select(
        F.get("q", 0).alias("md_q95"), F.get("q", 1).alias("md_q99")
    )
    hits = known.agg(
        F.avg((F.col("nearest_class") == as_col(label).cast("string")).cast("double")).alias(
            "nearest_class_accuracy")
    )
    app_rows = attach(measured(app, [id_col]), cuts, []).select(
        as_col(id_col), "global_mahalanobis",
        (F.col("global_mahalanobis") > F.col("md_q95")).alias("mahalanobis_outside_95"),
        (F.col("global_mahalanobis") > F.col("md_q99")).alias("mahalanobis_outside_99"),
        "nearest_class", "nearest_class_mahalanobis",
    )
    return app_rows, attach(cuts, hits, [])


def ellipse_overlap(
    ref: DataFrame, app: DataFrame, label: str, x: str, y: str, arc: str,
    min_n: int = 20, high: float = 0.5, low: float = 0.3,
) -> DataFrame:
    """Application rows inside the 95 % ellipse of every class on two coordinates.

    Classes below ``min_n`` rows or with a singular covariance are left out.
    """
    shape = ref.groupBy(as_col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("reference_n"),
        F.avg(as_col(x)).alias("mx"), F.avg(as_col(y)).alias("my"),
        F.var_samp(as_col(x)).alias("vx"), F.var_samp(as_col(y)).alias("vy"),
        F.covar_samp(as_col(x), as_col(y)).alias("vxy"),
    ).where(
        (F.col("reference_n") >= min_n)
        & (F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy") != 0)
    )
    # One row per class reaches every application row as an array.
    spaces = shape.agg(F.collect_list(F.struct("*")).alias("_classes"))
    wide = attach(app.select(as_col(x).alias("x"), as_col(y).alias("y"), as_col(arc).alias("p")),
                  spaces, [])
    rows = wide.select("x", "y", "p", F.explode("_classes").alias("c"))
    dx, dy = F.col("x") - F.col("c.mx"), F.col("y") - F.col("c.my")
    det = F.col("c.vx") * F.col("c.vy") - F.col("c.vxy") * F.col("c.vxy")
    d2 = (dx * dx * F.col("c.vy") - F.lit(2.0) * dx * dy * F.col("c.vxy") + dy * dy * F.col("c.vx")) / det
    inside, is_high, is_low = d2 < K.CHI2_95_2DF, F.col("p") >= high, F.col("p") < low
    pct = lambda part, whole: F.round(
        F.try_divide(F.lit(100.0) * F.count_if(part), F.count_if(whole)), 2)
    return rows.groupBy(F.col("c.class").alias("class")).agg(
        F.max("c.reference_n").alias("reference_n"),
        F.count_if(inside).alias("inside_all_n"),
        F.round(F.lit(100.0) * F.count_if(inside) / F.count(F.lit(1)), 2).alias("inside_all_pct"),
        F.count_if(inside & is_high).alias("inside_high_n"),
        pct(inside & is_high, is_high).alias("inside_high_pct"),
        F.count_if(inside & is_low).alias("inside_low_n"),
        pct(inside & is_low, is_low).alias("inside_low_pct"),
    )


# --- summaries of distances -------------------------------------------------------------------


def distance_thresholds(ref_dist: DataFrame, dist: str = "knn_distance") -> DataFrame:
    return exact_quantiles(ref_dist, [], dist, [0.95, 0.99]).select(
        F.get("q", 0).alias("q95"), F.get("q", 1).alias("q99")
    )


def coverage(
    app: DataFrame, thresholds: DataFrame, dist: str, arc: str, high: float = 0.5, low: float = 0.3
) -> DataFrame:
    """Percent of rows inside the 95 and 99 thresholds: all rows, high and low arc share."""
    groups = F.filter(
        F.array(
            F.lit("all"),
            F.when(as_col(arc) >= high, F.lit("high")),
            F.when(as_col(arc) < low, F.lit("low")),
        ),
        lambda g: g.isNotNull(),
    )
    rows = attach(app, thresholds, []).withColumn("group", F.explode(groups))
    inside = lambda q: F.round(
        F.lit(100.0) * F.avg((as_col(dist) <= F.col(q)).cast("double")), 1)
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), inside("q95").alias("cov95"), inside("q99").alias("cov99")
    )


def distance_histogram(
    app: DataFrame, thresholds: DataFrame, dist: str, bins: int = 45
) -> DataFrame:
    """Density of distances up to ``max(1.8*q99, P97)``: bin, edges, count, density."""
    upper = exact_quantiles(app, [], dist, [0.97]).select(F.get("q", 0).alias("_p97"))
    span = attach(upper, thresholds, []).select(
        F.greatest(F.lit(1.8) * F.col("q99"), F.col("_p97")).alias("_max")
    )
    wide = attach(app.select(as_col(dist).alias("_x")), span, []).where(
        (F.col("_x") >= 0) & (F.col("_x") <= F.col("_max"))
    )
    at = F.least(F.floor(F.col("_x") / F.col("_max") * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counts = wide.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.max("_max").alias("_max")
    )
    total = counts.agg(F.sum("count").alias("_all"))
    width = F.col("_max") / F.lit(float(bins))
    return attach(counts, total, []).select(
        "bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width).alias("hi"),
        "count", (F.col("count") / (F.col("_all") * width)).alias("density"),
    )


def sample_diagnostics(
    predictions: Mapping[str, DataFrame], distances: DataFrame, counts: DataFrame, id_col: str,
) -> DataFrame:
    """One row per sample: predictions of every variant, distances, counts and change flags.

    ``predictions`` maps current, median_impute and no_major_normalization to tables with the
    id, class, confidence and arc_probability.
    """
    out = counts
    for name, table in predictions.items():
        out = out.join(
            table.select(
                as_col(id_col),
                *[F.col(c).alias(f"{name}_{c}") for c in ("class", "confidence", "arc_probability")],
            ),
            id_col,
        )
    return out.join(distances, id_col).withColumns(
        {
            "imputation_changed_class": F.col("current_class") != F.col("median_impute_class"),
            "normalization_changed_class":
                F.col("current_class") != F.col("no_major_normalization_class"),
        }
    )
