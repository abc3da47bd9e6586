"""Bootstrap intervals, densities and kernel profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import uncertainty as U
from .agebins import binned
from .frames import draw_sql, hash_sql, register, samples, scored

REPS = 2000
SEED = 20240611
_POISSON = "CASE " + " ".join(
    f"WHEN h/{2147483647}.0::DOUBLE < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(U.POISSON_ONE_CDF)) + " ELSE 12 END"
_ROWS = ("(SELECT mid, sample_id, \"BA\"/\"LA\" AS x, \"Arc_probability3\" AS w FROM B WHERE \"BA\" > 0 AND \"LA\" > 0 AND \"Arc_probability3\" > 0 AND mid >= 2500)")
_STATS = "(SELECT mid, sum(x*w)/sum(w) AS weighted_mean, count(*) AS n, sum(w) AS weight_sum, sum(w)*sum(w)/sum(w*w) AS effective_n FROM R GROUP BY 1)"
_OUT = ("SELECT s.mid/1000.0 AS age_mid_ga, CASE WHEN n >= 3 THEN weighted_mean END AS weighted_mean, bootstrap_sem, bootstrap_ci_lo, bootstrap_ci_hi, n, weight_sum, CASE WHEN n >= 3 THEN effective_n END AS effective_n "
        f"FROM {_STATS} s LEFT JOIN (SELECT mid, stddev_samp(m) AS bootstrap_sem, quantile_cont(m, 0.025) AS bootstrap_ci_lo, quantile_cont(m, 0.975) AS bootstrap_ci_hi FROM M GROUP BY 1) b ON s.mid = b.mid")
_DOUBLES = "age_mid_ga weighted_mean bootstrap_sem bootstrap_ci_lo bootstrap_ci_hi weight_sum effective_n"
_POIS_SQL = f"""SELECT * FROM (WITH R AS {_ROWS}, D AS (SELECT mid, x, w, rep, {draw_sql('sample_id', 'rep', SEED)} AS h FROM R, range(1, {REPS + 1}) AS g(rep)),
  C AS (SELECT *, {_POISSON} AS c FROM D), M AS (SELECT mid, rep, sum(c*w*x)/sum(c*w) AS m FROM C WHERE c > 0 GROUP BY 1, 2) {_OUT}) q"""
_MULTI_SQL = f"""SELECT * FROM (WITH R AS {_ROWS}, K AS (SELECT *, count(*) OVER (PARTITION BY mid) AS nn, row_number() OVER (PARTITION BY mid ORDER BY {hash_sql(SEED)}, sample_id) AS pos FROM R),
  D AS (SELECT mid, rep, {draw_sql('sample_id', 'rep', SEED)} % nn + 1 AS pos, count(*) AS c FROM K, range(1, {REPS + 1}) AS g(rep) WHERE nn >= 3 GROUP BY 1, 2, 3),
  M AS (SELECT D.mid, rep, sum(c*w*x)/sum(c*w) AS m FROM D JOIN K ON D.mid = K.mid AND D.pos = K.pos GROUP BY 1, 2) {_OUT}) q"""


def _weighted(spark, sf, method):
    rows = binned(spark, sf).select(
        "sample_id", F.col("age_bin.mid").alias("mid"), F.when((F.col("BA") > 0) & (F.col("LA") > 0), F.try_divide("BA", "LA")).alias("x"),
        F.greatest("Arc_probability3", F.lit(0.0)).alias("w")).where("mid >= 2500")
    out = U.weighted_bootstrap(rows, ["mid"], "x", "w", REPS, SEED, method=method)
    return out.select((F.col("mid") / 1000.0).alias("age_mid_ga"), *[c for c in out.columns if c != "mid"])


register("m1_weighted_bootstrap_poisson", _POIS_SQL, _DOUBLES, "E B")(lambda s, d: _weighted(s, d, "poisson"))
register("m1_weighted_bootstrap", _MULTI_SQL, _DOUBLES, "E B")(lambda s, d: _weighted(s, d, "multinomial"))


def _interval_sql(counts: str, key: str) -> str:
    """Binomial quantiles by a running sum over all counts of a group."""
    return f"""SELECT {key}, n, k/n AS frac, min(i) FILTER (f >= 0.025)/n AS lo, min(i) FILTER (f >= 0.975)/n AS hi FROM (
      SELECT {key}, n, k, i, sum(m) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS f FROM (
        SELECT {key}, n, k, i, CASE WHEN k = 0 THEN CAST(i = 0 AS INTEGER)::DOUBLE WHEN k = n THEN CAST(i = n AS INTEGER)::DOUBLE
          ELSE exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i*ln(k/n) + (n - i)*ln(1 - k/n)) END AS m
        FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM ({counts}) c) r) t) u GROUP BY {key}, n, k"""


@register("m2_proportion_ci", _interval_sql(
    "SELECT mid/1000.0 AS age_mid_ga, count(*) AS n, count(*) FILTER (\"Arc_probability3\" >= 0.1) AS k FROM B WHERE mid >= 2500 GROUP BY mid", "age_mid_ga"),
    "age_mid_ga frac lo hi", "E B")
def m2(spark, sf):
    rows = binned(spark, sf).withColumn("age_mid_ga", F.col("age_bin.mid") / 1000.0).where("age_bin.mid >= 2500")
    return U.proportion_ci(rows, ["age_mid_ga"], F.col("Arc_probability3") >= 0.1)


@register("m2_proportion_ci_from_counts", _interval_sql(
    "SELECT \"POOL_COMPONENT\" AS part, count(*) AS n, count(*) FILTER (is_arc_related_9class) AS k FROM E GROUP BY 1", "part"), "frac lo hi", "E")
def m2b(spark, sf):
    counts = scored(spark, sf).groupBy(F.col("POOL_COMPONENT").alias("part")).agg(
        F.count(F.lit(1)).alias("size"), F.count_if("is_arc_related_9class").alias("hits"))
    return U.proportion_ci(counts, ["part"], n="size", k="hits")


_DENS = """SELECT * FROM (WITH F AS (SELECT source AS g, quantile_cont(log10(m2), 0.005) AS lo, quantile_cont(log10(m2), 0.995) AS hi, stddev_pop(log10(m2)) AS sd, count(*) AS n FROM S GROUP BY 1),
  H AS (SELECT g, CAST(least(floor((log10(m2)-lo)/((hi-lo)/256.0)), 255) AS INTEGER) AS b, count(*) AS c FROM S JOIN F ON source = g WHERE log10(m2) BETWEEN lo AND hi GROUP BY 1, 2),
  P AS (SELECT F.g, lo, (hi-lo)/256.0 AS w, greatest(1.06*sd*pow(n, -0.2)/((hi-lo)/256.0), 1.0) AS s, (SELECT sum(c) FROM H WHERE H.g = F.g) AS t FROM F),
  O AS (SELECT g, o, exp(-0.5*(o/s)*(o/s)) AS e FROM P, range(-200, 201) AS k(o) WHERE abs(o) <= ceil(4.0*s)),
  N AS (SELECT g, sum(e) AS z FROM O GROUP BY 1)
  SELECT P.g AS source, CAST(i AS INTEGER) AS bin, lo + (i+0.5)*w AS centre, coalesce((SELECT sum(c*e) FROM H JOIN O ON H.g = O.g AND H.b = i + O.o WHERE H.g = P.g), 0)/(t*w*z) AS density
  FROM P JOIN N ON P.g = N.g, range(256) AS r(i)) q"""


@register("m3_density_1d", _DENS, "centre density", "S")
def m3(spark, sf):
    s = samples(spark, sf).withColumn("x", F.log10("m2"))
    return U.density_1d(s, ["source"], "x")


_GRID = """(WITH C AS (SELECT least(floor((m2-0.0)/(110.0/150)), 149) AS ix, least(floor((m3-0.0)/(12.0/120)), 119) AS iy, count(*)*1.0 AS v FROM S WHERE m2 BETWEEN 0 AND 110 AND m3 BETWEEN 0 AND 12 GROUP BY 1, 2),
  T AS (SELECT ix, iy, v/sum(v) OVER () AS v FROM C), O AS (SELECT o, exp(-0.5*(o/6.0)*(o/6.0)) AS e FROM range(-24, 25) AS k(o)), Z AS (SELECT sum(e) AS z FROM O),
  A AS (SELECT i AS ix, iy, sum(v*e)/max(z) AS v FROM T, O, Z, range(150) AS r(i) WHERE i = ix + o GROUP BY 1, 2),
  B2 AS (SELECT ix, j AS iy, sum(v*e)/max(z) AS v FROM A, O, Z, range(120) AS r(j) WHERE j = iy + o GROUP BY 1, 2)
  SELECT CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iy, coalesce(v, 0)/(SELECT max(v) FROM B2) AS density FROM range(150) AS r1(i) CROSS JOIN range(120) AS r2(j) LEFT JOIN B2 ON ix = i AND iy = j)"""


def _grid(spark, sf):
    return U.density_2d(samples(spark, sf), "m2", "m3", (0.0, 110.0), (0.0, 12.0))


@register("m4_density_2d", f"SELECT * FROM {_GRID} g", "density", "S")
def m4(spark, sf):
    return _grid(spark, sf)


@register("m5_mass_level",
          f"SELECT f AS fraction, max(density) FILTER (s >= f) AS level FROM (SELECT density, sum(density) OVER (ORDER BY density DESC ROWS UNBOUNDED PRECEDING)/sum(density) OVER () AS s FROM {_GRID} g WHERE density > 0) t, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) AS v(f) GROUP BY 1", "level", "S")
def m5(spark, sf):
    grid = _grid(spark, sf)
    parts = [U.mass_level(grid, f).withColumn("fraction", F.lit(f)) for f in (0.5, 0.9)]
    return parts[0].unionByName(parts[1])


@register("m6_robust_range",
          " UNION ALL ".join(f"SELECT '{c}' AS feature, a - (b-a)*0.06 AS lo, b + (b-a)*0.06 AS hi FROM (SELECT quantile_cont({c}, 0.005) AS a, quantile_cont({c}, 0.995) AS b FROM S) t" for c in ("m2", "m3")), "lo hi", "S")
def m6(spark, sf):
    return U.robust_range(samples(spark, sf), ["m2", "m3"])


_KERNEL = """SELECT unit, CAST(i AS INTEGER) AS i, grid, CASE WHEN max(d) OVER (PARTITION BY unit) > 0 THEN d/max(d) OVER (PARTITION BY unit) ELSE d END AS density FROM (
  SELECT unit, i, 2.4 + i*(1.6/599.0) AS grid, sum(exp(-(2.4 + i*(1.6/599.0) - a)*(2.4 + i*(1.6/599.0) - a)/(2*0.06*0.06))) AS d FROM (
    SELECT "Craton" AS unit, "C_AGE"/1000.0 AS a FROM E WHERE "Craton" IS NOT NULL AND "C_AGE" IS NOT NULL AND "Arc_probability3" >= 0.2 UNION ALL SELECT 'nowhere', 3.05) t, range(600) AS g(i) GROUP BY 1, 2) k"""


@register("m7_kernel_profile", _KERNEL, "grid density", "E")
def m7(spark, sf):
    e = scored(spark, sf).where("Craton IS NOT NULL AND Arc_probability3 >= 0.2").withColumn("ga", F.col("C_AGE") / 1000.0)
    return U.kernel_profile(e, "Craton", "ga", 2.4, 4.0, nominal={"nowhere": 3.05, "unit 3": 2.7})
