"""Drift and applicability domain: even vec_id is the reference, odd the application side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import domain as D
from ..operators import encode as X
from ..operators import neighbours as K
from ..operators import score as R
from .frames import probabilities, register, samples

ARC_CLASSES = ["class 0", "class 1", "class 2"]
NAMES = [f"class {i}" for i in range(10)]


def _sides(spark, sf):
    p = probabilities(spark, sf)
    return p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1")


@register("h10_ks_two_sample",
          """SELECT feature, max(abs(cr/tr - ca/ta)) AS ks FROM (
             SELECT feature, v, sum(CAST(g AS DOUBLE)) OVER w AS cr, sum(CAST(1-g AS DOUBLE)) OVER w AS ca, sum(g) OVER (PARTITION BY feature) AS tr, sum(1-g) OVER (PARTITION BY feature) AS ta FROM (
               SELECT 'm2' AS feature, log10(m2) AS v, CAST(source = 'F' AS INTEGER) AS g FROM S WHERE m2 > 0 UNION ALL SELECT 'm3', log10(m3), CAST(source = 'F' AS INTEGER) FROM S WHERE m3 > 0) t
             WINDOW w AS (PARTITION BY feature ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q GROUP BY 1""", "ks", "S")
def h10(spark, sf):
    return D.ks_two_sample(samples(spark, sf), "source", "F", ["m2", "m3"])


_KNN = """SELECT {id} AS vec_id, avg(d) AS knn_distance FROM (
  SELECT a.vec_id, list_distance(a.v, r.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, r.v)) AS k
  FROM (SELECT vec_id, vec AS v FROM V WHERE vec_id % 2 = {side}) a JOIN (SELECT vec_id, vec AS v FROM V WHERE vec_id % 2 = 0) r ON a.vec_id <> r.vec_id) t
  WHERE k <= {k} GROUP BY a_id""".replace("{id}", "vec_id").replace("a_id", "vec_id")


@register("j10_e8_knn_distance_application", _KNN.format(side=1, k=11), "knn_distance", "P")
def j10(spark, sf):
    ref, app = _sides(spark, sf)
    return K.knn_distance(ref, app, "vec_id", "vec", 10, 11)[1]


@register("j10_knn_distance_reference", _KNN.format(side=0, k=10), "knn_distance", "P")
def j10b(spark, sf):
    ref, app = _sides(spark, sf)
    return K.knn_distance(ref, app, "vec_id", "vec", 10)[0]


def _knn_coverage(spark, sf):
    ref, app = _sides(spark, sf)
    ref_d, app_d = K.knn_distance(ref, app, "vec_id", "vec", 10)
    arc = R.arc_probability("probs", NAMES, ARC_CLASSES)
    return ref_d, app_d.join(app.select("vec_id", arc.alias("arc")), "vec_id")


_COVER = f"""
  WITH R AS ({_KNN.format(side=0, k=10)}), A AS ({_KNN.format(side=1, k=10)}),
  T AS (SELECT quantile_cont(knn_distance, 0.95) AS q95, quantile_cont(knn_distance, 0.99) AS q99 FROM R),
  J AS (SELECT A.vec_id, knn_distance, probs[1]+probs[2]+probs[3] AS arc FROM A JOIN P ON A.vec_id = P.vec_id)"""


@register("g29_coverage",
          f"""SELECT * FROM ({_COVER} SELECT grp AS "group", count(*) AS n, round(100.0*count(*) FILTER (knn_distance <= q95)/count(*), 1) AS cov95, round(100.0*count(*) FILTER (knn_distance <= q99)/count(*), 1) AS cov99
              FROM J, T, (VALUES ('all'), ('high'), ('low')) AS v(grp) WHERE grp = 'all' OR (grp = 'high' AND arc >= 0.5) OR (grp = 'low' AND arc < 0.3) GROUP BY grp) q""", "cov95 cov99", "P")
def g29(spark, sf):
    ref_d, app_d = _knn_coverage(spark, sf)
    return D.coverage(app_d, D.distance_thresholds(ref_d), "knn_distance", "arc")


@register("j18_distance_histogram",
          f"""SELECT * FROM ({_COVER}, M AS (SELECT greatest(1.8*max(q99), quantile_cont(knn_distance, 0.97)) AS mx FROM J, T)
              SELECT CAST(b AS INTEGER) AS bin, b*max(mx)/45.0 AS lo, (b+1)*max(mx)/45.0 AS hi, count(*) AS count, count(*)/(sum(count(*)) OVER ()*max(mx)/45.0) AS density
              FROM (SELECT least(floor(knn_distance/mx*45), 44) AS b, mx FROM J, M WHERE knn_distance BETWEEN 0 AND mx) t GROUP BY b) q""", "lo hi density", "P")
def j18(spark, sf):
    ref_d, app_d = _knn_coverage(spark, sf)
    return D.distance_histogram(app_d, D.distance_thresholds(ref_d), "knn_distance")


@register("j14_ellipse_overlap",
          """SELECT class, max(n) AS reference_n, count(*) FILTER (i) AS inside_all_n, round(100.0*count(*) FILTER (i)/count(*), 2) AS inside_all_pct,
             count(*) FILTER (i AND p >= 0.5) AS inside_high_n, round(100.0*count(*) FILTER (i AND p >= 0.5)/nullif(count(*) FILTER (p >= 0.5), 0), 2) AS inside_high_pct,
             count(*) FILTER (i AND p < 0.3) AS inside_low_n, round(100.0*count(*) FILTER (i AND p < 0.3)/nullif(count(*) FILTER (p < 0.3), 0), 2) AS inside_low_pct FROM (
               SELECT class, n, p, ((x-mx)*(x-mx)*vy - 2.0*(x-mx)*(y-my)*vxy + (y-my)*(y-my)*vx)/(vx*vy - vxy*vxy) < 5.9915 AS i FROM
                 (SELECT label AS class, count(*) AS n, avg(vec[1]) mx, avg(vec[2]) my, var_samp(vec[1]) vx, var_samp(vec[2]) vy, covar_samp(vec[1], vec[2]) vxy FROM P WHERE vec_id % 2 = 0 GROUP BY 1 HAVING count(*) >= 20) c,
                 (SELECT vec[1] AS x, vec[2] AS y, probs[1]+probs[2]+probs[3] AS p FROM P WHERE vec_id % 2 = 1) a) t GROUP BY class""",
          "inside_all_pct inside_high_pct inside_low_pct", "P")
def j14(spark, sf):
    ref, app = _sides(spark, sf)
    point = {"x": F.get("vec", 0), "y": F.get("vec", 1), "arc": R.arc_probability("probs", NAMES, ARC_CLASSES)}
    return D.ellipse_overlap(ref.withColumns(point), app.withColumns(point), "label", "x", "y", "arc")


_CENTRED = """(WITH X AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(vec) AS x FROM V WHERE vec_id % 2 = 0), M AS (SELECT i, avg(x) AS m FROM X GROUP BY 1)
  SELECT vec_id, X.i AS i, x - m AS d FROM X JOIN M ON X.i = M.i)"""


@register("j11_pca_lengths", """SELECT * FROM (WITH X AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(vec) AS x FROM V), M AS (SELECT i, avg(x) AS m FROM X WHERE vec_id % 2 = 0 GROUP BY 1)
  SELECT vec_id, sum((x - m)*(x - m)) AS squared FROM X JOIN M ON X.i = M.i GROUP BY 1) q""", "squared", "P")
def j11_lengths(spark, sf):
    """All components keep a row's distance to the reference mean: the projection is orthonormal and centred."""
    ref, app = _sides(spark, sf)
    pcs = D.project(ref.unionByName(app), D.fit_pca(ref, "vec"), "vec", 64)
    return pcs.select("vec_id", F.aggregate("pcs", F.lit(0.0), lambda a, x: a + x * x).alias("squared"))


@register("j11_whitened_moments", "SELECT CAST(i AS INTEGER) AS component, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance FROM range(1, 65) AS r(i)", "mean variance")
def j11_moments(spark, sf):
    """Whitened reference coordinates have mean 0 and variance 1 on every component (rounded to six places)."""
    ref, _ = _sides(spark, sf)
    white = D.whiten(D.project(ref, D.fit_pca(ref, "vec"), "vec", 64), [], "pcs")[0]
    cells = white.select(F.posexplode("pcs").alias("at", "x"))
    return cells.groupBy((F.col("at") + 1).alias("component")).agg(
        F.abs(F.round(F.avg("x"), 6)).alias("mean"), F.round(F.var_pop("x"), 6).alias("variance"))


@register("j13_shrunk_covariance", f"""SELECT * FROM (WITH C AS {_CENTRED},
  K AS (SELECT a.i AS i, b.i AS j, sum(a.d*b.d)/count(*) AS c, count(*) AS n FROM C a JOIN C b ON a.vec_id = b.vec_id GROUP BY 1, 2),
  Q AS (SELECT sum(l*l) AS fourth FROM (SELECT vec_id, sum(d*d) AS l FROM C GROUP BY 1) r),
  T AS (SELECT sum(c*c) AS spread, sum(c) FILTER (i = j) AS trace, max(n) AS n FROM K),
  W AS (SELECT trace/64.0 AS mu, (spread - trace*trace/64.0)/64.0 AS distance, (fourth/n - spread)/(64.0*n) AS noise FROM T, Q)
  SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(round(100000000*((1 - least(noise, distance)/distance)*c + CASE WHEN i = j THEN least(noise, distance)/distance*mu ELSE 0 END)) AS BIGINT) AS covariance_e8 FROM K, W) q""", views="P")
def j13_shrunk(spark, sf):
    """The inverse of the precision that the distances use, entry by entry in units of 1e-8: the shrunk covariance."""
    ref, _ = _sides(spark, sf)
    held = np.linalg.inv(D._moments(ref, "vec", None)["_all"].shrunk_precision())
    rows = [(i + 1, j + 1, round(1e8 * float(v))) for (i, j), v in np.ndenumerate(held)]
    return spark.createDataFrame(rows, "i int, j int, covariance_e8 long")


@register("j13_mahalanobis")
def j13(spark, sf):
    ref, app = _sides(spark, sf)
    return D.mahalanobis(ref, app, "vec", "label", "vec_id")[0]


@register("j13_mahalanobis_thresholds")
def j13b(spark, sf):
    ref, app = _sides(spark, sf)
    return D.mahalanobis(ref, app, "vec", "label", "vec_id")[1]


@register("j11_pca_project_whiten")
def j11(spark, sf):
    ref, app = _sides(spark, sf)
    pca = D.fit_pca(ref, "vec")
    n = pca.n_for(0.85)
    white_ref, white_app = D.whiten(D.project(ref, pca, "vec", n), [D.project(app, pca, "vec", n)], "pcs")
    return white_ref.unionByName(white_app).select("vec_id", "pcs")


@register("j15_pca_loadings")
def j15(spark, sf):
    ref, _ = _sides(spark, sf)
    return D.loadings(D.fit_pca(ref, "vec"), [f"dim {i:02d}" for i in range(64)], spark)


_RANK = "rank() OVER (PARTITION BY f1, f2 ORDER BY {v}) + (count(*) OVER (PARTITION BY f1, f2, {v}) - 1)/2.0"
_PAIRS = [("m1", "m3"), ("m1", "m4"), ("m3", "m4")]
_PAIR_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, {a} AS x, {b} AS y FROM S WHERE {a} > 0 AND {b} > 0 AND source = 'O'" for a, b in _PAIRS)


@register("j12_h11_observed_spearman",
          f"SELECT f1, f2, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT f1, f2, {_RANK.format(v='x')} AS rx, {_RANK.format(v='y')} AS ry FROM ({_PAIR_ROWS}) t) q GROUP BY 1, 2", "rho", "S")
def h11(spark, sf):
    return D.observed_spearman(samples(spark, sf).where("source = 'O'"), ["m1", "m3", "m4"])


def _full_rank(side: str) -> str:
    rank = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0"
    cells = ", ".join(f"{rank.format(c=c)} AS r{i}" for i, c in enumerate(["m1", "a3", "a4"]))
    return f"(SELECT {cells} FROM (SELECT m1, coalesce(m3, 5.5) AS a3, coalesce(m4, 4.5) AS a4 FROM S WHERE source = '{side}') t)"


@register("j12_correlation_shift",
          "SELECT element_1, element_2, a AS reference_spearman, b AS imputed_spearman, rho AS observed_spearman, n AS observed_pair_n, abs(b-a) AS imputed_vs_reference_abs_delta, abs(b-rho) AS imputation_correlation_change FROM (" +
          " UNION ALL ".join(
              f"SELECT '{x}' AS element_1, '{y}' AS element_2, (SELECT corr(r{i}, r{j}) FROM {_full_rank('F')} f) AS a, (SELECT corr(r{i}, r{j}) FROM {_full_rank('O')} o) AS b"
              for i, j, x, y in ((0, 1, "m1", "m3"), (0, 2, "m1", "m4"), (1, 2, "m3", "m4"))) +
          f") s JOIN (SELECT f1, f2, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT f1, f2, {_RANK.format(v='x')} AS rx, {_RANK.format(v='y')} AS ry FROM ({_PAIR_ROWS}) t) q GROUP BY 1, 2) o ON element_1 = f1 AND element_2 = f2",
          "reference_spearman imputed_spearman observed_spearman imputed_vs_reference_abs_delta imputation_correlation_change", "S")
def j12(spark, sf):
    s = samples(spark, sf)
    full = s.fillna({"m3": 5.5, "m4": 4.5})
    return D.correlation_shift(full.where("source = 'F'"), full.where("source = 'O'"), s.where("source = 'O'"), ["m1", "m3", "m4"])


_EL = """SELECT '{c}' AS feature, (SELECT 100.0*count(*) FILTER ({c} IS NULL)/count(*) FROM S WHERE source = 'F') AS ref_missing_pct,
  (SELECT 100.0*count(*) FILTER ({c} IS NULL OR {c} <= 0)/count(*) FROM S WHERE source = 'O') AS app_missing_or_nonpositive_pct,
  (SELECT 100.0*count(*) FILTER ({c} IS NULL OR {c} <= 0)/count(*) FROM S WHERE source = 'O') AS app_imputed_pct,
  (SELECT median(coalesce({c}, 5.5)) FROM S WHERE source = 'F') AS ref_median, (SELECT median(coalesce({c}, 5.5)) FROM S WHERE source = 'O') AS app_median,
  (SELECT log10(median(coalesce({c}, 5.5))) FROM S WHERE source = 'O') - (SELECT log10(median(coalesce({c}, 5.5))) FROM S WHERE source = 'F') AS median_log10_shift,
  (SELECT max(abs(cr/tr - ca/ta)) FROM (SELECT sum(CAST(g AS DOUBLE)) OVER w AS cr, sum(CAST(1-g AS DOUBLE)) OVER w AS ca, sum(g) OVER () AS tr, sum(1-g) OVER () AS ta FROM
     (SELECT log10(coalesce({c}, 5.5)) AS v, CAST(source = 'F' AS INTEGER) AS g FROM S) t WINDOW w AS (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q) AS log10_ks_statistic,
  (SELECT 100.0*count(*) FILTER (coalesce({c}, 5.5) <= 2)/count(*) FROM S WHERE source = 'O') AS app_bin_1_pct,
  (SELECT 100.0*count(*) FILTER (coalesce({c}, 5.5) > 7)/count(*) FROM S WHERE source = 'O') AS app_bin_4_pct,
  (SELECT 100.0*count(*) FILTER (coalesce({c}, 5.5) <= 2 OR coalesce({c}, 5.5) > 7)/count(*) FROM S WHERE source = 'O') AS app_boundary_pct"""


@register("j16_element_summary", " UNION ALL ".join(_EL.format(c=c) for c in ("m3", "m4")),
          "ref_missing_pct app_missing_or_nonpositive_pct app_imputed_pct ref_median app_median median_log10_shift log10_ks_statistic app_bin_1_pct app_bin_4_pct app_boundary_pct", "S")
def j16(spark, sf):
    cols = ["m3", "m4"]
    s = samples(spark, sf)
    full = s.fillna(5.5, cols)
    codes = X.quantile_encode(full.where("source = 'O'"), {c: [2.0, 5.0, 7.0] for c in cols}, codes=4)
    return D.element_summary(s.where("source = 'F'"), full.where("source = 'F'"), s.where("source = 'O'"),
                             full.where("source = 'O'"), codes, cols, codes=4)


@register("j17_sample_diagnostics",
          """SELECT sample_id, missing_feature_count, boundary_feature_count, knn_distance, c1 AS current_class, f1 AS current_confidence, a1 AS current_arc_probability,
             c2 AS median_impute_class, f2 AS median_impute_confidence, a2 AS median_impute_arc_probability, c3 AS no_major_normalization_class, f3 AS no_major_normalization_confidence, a3 AS no_major_normalization_arc_probability,
             c1 <> c2 AS imputation_changed_class, c1 <> c3 AS normalization_changed_class FROM (
             SELECT vec_id AS sample_id, CAST(label AS INTEGER) AS missing_feature_count, CAST(label + 1 AS INTEGER) AS boundary_feature_count, vec[1] AS knn_distance, """ +
          ", ".join(f"concat('class ', CAST(list_position({p}, list_max({p})) - 1 AS VARCHAR)) AS c{i}, list_max({p}) AS f{i}, 0.0 + {p}[1] + {p}[2] + {p}[3] AS a{i}"
                    for i, p in ((1, "probs"), (2, "list_reverse(probs)"), (3, "(probs[2:10] || probs[1:1])"))) + " FROM P) t",
          "knn_distance current_confidence current_arc_probability median_impute_confidence median_impute_arc_probability no_major_normalization_confidence no_major_normalization_arc_probability", "P")
def j17(spark, sf):
    p = probabilities(spark, sf).withColumnRenamed("vec_id", "sample_id")
    variants = {
        "current": F.col("probs"), "median_impute": F.reverse("probs"),
        "no_major_normalization": F.concat(F.slice("probs", 2, 9), F.slice("probs", 1, 1))}
    frames = {n: R.prediction_frame(p.withColumn("q", c), "q", NAMES, "sample_id", ARC_CLASSES) for n, c in variants.items()}
    counts = p.select("sample_id", F.col("label").alias("missing_feature_count"), (F.col("label") + 1).alias("boundary_feature_count"))
    return D.sample_diagnostics(frames, p.select("sample_id", F.get("vec", 0).alias("knn_distance")), counts, "sample_id")
