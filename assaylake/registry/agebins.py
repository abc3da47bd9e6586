"""Age bins, regions, cases, components, drift summaries, windows, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import ratio_nz
from ..operators import score as R
from ..operators import summaries as G
from ..operators import uncertainty as U
from .frames import ARC, CLASSES, register, samples, scored, table

HIGH, IS_ARC, BASE = "is_high_confidence", "is_arc_related_9class", "liu_arc_binary"
BIN = "concat(CAST(CAST(lo AS BIGINT) AS VARCHAR), '–', CAST(CAST(hi AS BIGINT) AS VARCHAR), ' Ma')"
GA = "mid/1000.0"


def binned(spark, sf):
    return G.add_age_bins(scored(spark, sf), "C_AGE", 200.0)


def _share(flag: str, scale: str = "") -> str:
    return f"{scale}count(*) FILTER ({flag})/count(*)"


@register("g11_age_bins",
          """SELECT sample_id, lo, mid AS age_bin_mid_ma, CASE WHEN mid IS NULL THEN '' ELSE concat(printf('%.1f', lo/1000.0), '–', printf('%.1f', hi/1000.0), ' Ga') END AS age_bin_label
             FROM (SELECT E.sample_id, lo, mid, hi FROM E LEFT JOIN B USING (sample_id)) t""", views="E B")
def g11(spark, sf):
    return binned(spark, sf).select("sample_id", F.col("age_bin.lo").alias("lo"), "age_bin_mid_ma", "age_bin_label")


_PER_CLASS = ", ".join(
    f"count(*) FILTER (pred_class_name = '{c}') AS n_{c}, {_share(f'pred_class_name = {chr(39)}{c}{chr(39)}')} AS ratio_{c}" for c in CLASSES)


@register("g10_summarize_by_age",
          f"""SELECT {BIN} AS age_bin, {GA} AS age_mid_ga, count(*) AS n_all, count(*) FILTER ({HIGH}) AS n_high,
              count(*) FILTER ({IS_ARC}) AS n_9class_arc_all, {_share(IS_ARC)} AS ratio_9class_arc_all, avg("Arc_probability3") AS mean_arc_probability,
              {_share('"Arc_probability3" >= 0.5')} AS ratio_arc_probability_ge_0_5, count(*) FILTER ({HIGH} AND {IS_ARC}) AS n_9class_arc_high,
              count(*) FILTER ({HIGH} AND {IS_ARC})/nullif(count(*) FILTER ({HIGH}), 0) AS ratio_9class_arc_high, count({BASE}) AS n_liu_samples,
              count(*) FILTER ({BASE}) AS n_liu_arc, count(*) FILTER ({BASE})/nullif(count({BASE}), 0) AS ratio_liu_arc, avg(pred_prob_max) AS mean_pred_prob, {_PER_CLASS}
              FROM B GROUP BY lo, mid, hi""",
          "age_mid_ga ratio_9class_arc_all mean_arc_probability ratio_arc_probability_ge_0_5 ratio_9class_arc_high ratio_liu_arc mean_pred_prob " + " ".join(f"ratio_{c}" for c in CLASSES),
          "E B")
def g10(spark, sf):
    return G.summarize_by_age(binned(spark, sf), CLASSES)


@register("g12_baseline_by_age",
          f"""SELECT {GA} AS age_mid_ga, count(*) AS n_liu_samples, count(*) FILTER (knn_distance >= 0.5) AS n_liu_arc, {_share('knn_distance >= 0.5')} AS ratio_liu_arc FROM B GROUP BY mid""",
          "age_mid_ga ratio_liu_arc", "E B")
def g12(spark, sf):
    return G.baseline_by_age(scored(spark, sf), "C_AGE", "knn_distance")


@register("g13_arc_ratio_by_threshold",
          f"""SELECT {GA} AS age_mid_ga, t AS threshold, count(*) FILTER ("Arc_probability3" >= t) AS n_high, count(*) FILTER ("Arc_probability3" >= t)/count(*) AS ratio_arc
              FROM B, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.6 AS DOUBLE)), (CAST(0.7 AS DOUBLE)), (CAST(0.8 AS DOUBLE))) AS v(t) GROUP BY mid, t""", "age_mid_ga ratio_arc", "E B")
def g13(spark, sf):
    return G.arc_ratio(binned(spark, sf))


@register("g14_summarize_regions",
          f"""SELECT m."Craton", n_all, n_high, n_9class_arc_high, oldest AS "oldest_9class_arc_high_C_AGE_Ma", youngest AS "youngest_9class_arc_high_C_AGE_Ma", n_liu_arc, oldest_liu AS "oldest_liu_arc_C_AGE_Ma",
              coalesce(cls, '') AS dominant_high_arc_class FROM (
                SELECT "Craton", count(*) AS n_all, count(*) FILTER ({HIGH}) AS n_high, count(*) FILTER ({HIGH} AND {IS_ARC}) AS n_9class_arc_high,
                max("C_AGE") FILTER ({HIGH} AND {IS_ARC}) AS oldest, min("C_AGE") FILTER ({HIGH} AND {IS_ARC}) AS youngest, count(*) FILTER ({BASE}) AS n_liu_arc,
                max("C_AGE") FILTER ({BASE}) AS oldest_liu FROM E GROUP BY 1) m
              LEFT JOIN (SELECT "Craton", pred_class_name AS cls, row_number() OVER (PARTITION BY "Craton" ORDER BY count(*) DESC, pred_class_name) AS r FROM E WHERE {HIGH} AND {IS_ARC} GROUP BY 1, 2) d
              ON m."Craton" IS NOT DISTINCT FROM d."Craton" AND r = 1""", views="E")
def g14(spark, sf):
    return G.summarize_regions(scored(spark, sf))


@register("g15_summarize_indicators",
          f"""SELECT {BIN} AS age_bin, {GA} AS age_mid_ga, subset, count(*) AS n, avg(bt) AS "mean_Ba_Th", median(bt) AS "median_Ba_Th", avg(tn) AS "mean_Th_Nb", median(tn) AS "median_Th_Nb",
              avg(bl) AS "mean_Ba_La", median(bl) AS "median_Ba_La" FROM (SELECT *, "BA"/nullif("TH",0) AS bt, "TH"/nullif("NB",0) AS tn, "BA"/nullif("LA",0) AS bl FROM B) t,
              (VALUES ('all'), ('high_9class_arc')) AS v(subset) WHERE subset = 'all' OR ({HIGH} AND {IS_ARC}) GROUP BY lo, mid, hi, subset""",
          "age_mid_ga mean_Ba_Th median_Ba_Th mean_Th_Nb median_Th_Nb mean_Ba_La median_Ba_La", "E B")
def g15(spark, sf):
    return G.summarize_indicators(binned(spark, sf))


_COUNTS = ", ".join(f"count(*) FILTER (pred_class_name = '{c}') AS n_{c}" for c in CLASSES)
_RATIOS = ", ".join(f"count(*) FILTER (pred_class_name = '{c}')/count(*) AS ratio_{c}" for c in CLASSES)


@register("g16_class_by_bin", f"SELECT mid AS age_bin_mid_ma, {_COUNTS}, {_RATIOS} FROM B GROUP BY mid",
          " ".join(f"ratio_{c}" for c in CLASSES), "E B")
def g16(spark, sf):
    return G.class_by_bin(binned(spark, sf), CLASSES)


@register("g17_summarize_cases",
          f"""SELECT "Craton", count(*) AS n_samples, count(*) FILTER ({IS_ARC}) AS arc_related_count, {_share(IS_ARC)} AS arc_related_pct, count(*) FILTER ({HIGH}) AS high_confidence_count,
              count(*) FILTER ({HIGH} AND {IS_ARC}) AS high_confidence_arc_count, """ + ", ".join(f"count(*) FILTER (pred_class_name = '{c}') AS n_{c[:2]}" for c in CLASSES) +
          " FROM E WHERE \"Craton\" IS NOT NULL GROUP BY 1", "arc_related_pct", "E")
def g17(spark, sf):
    return G.summarize_cases(scored(spark, sf).where("Craton IS NOT NULL"), "Craton", {c: c[:2] for c in CLASSES}, ARC)


@register("g18_case_composition",
          f"""SELECT "Craton", pred_class_name, n, 100.0*sum(CASE WHEN pred_class_name IN ('click','view') THEN n ELSE 0 END) OVER (PARTITION BY "Craton")/sum(n) OVER (PARTITION BY "Craton") AS arc_percent
              FROM (SELECT "Craton", pred_class_name, count(*) AS n FROM E GROUP BY 1, 2) t""", "arc_percent", "E")
def g18(spark, sf):
    return G.case_composition(scored(spark, sf), "Craton", ARC)


def _component(spark, sf):
    return scored(spark, sf).withColumns({
        "High_arc_P_ge_0_5": F.col("Arc_probability3") >= 0.5, "Prediction_confidence": F.col("pred_prob_max")})


@register("g19_component_summary",
          """SELECT CASE WHEN grouping("POOL_COMPONENT") = 1 THEN 'ALL_EXPANDED' ELSE "POOL_COMPONENT" END AS component, count(*) AS n, count(*) FILTER (h) AS high_arc_n,
             100.0*count(*) FILTER (h)/count(*) AS high_arc_pct, count(*) FILTER (h AND NOT knn_outside_99) AS high_arc_in_99_domain_n,
             100.0*count(*) FILTER (knn_outside_99)/count(*) AS knn_outside_99_pct, avg(pred_prob_max) AS mean_confidence
             FROM (SELECT *, "Arc_probability3" >= 0.5 AS h FROM E) t GROUP BY ROLLUP("POOL_COMPONENT")""", "high_arc_pct knn_outside_99_pct mean_confidence", "E")
def g19(spark, sf):
    return G.component_summary(_component(spark, sf))


def _drift(spark, sf):
    e = scored(spark, sf)
    return e.select(
        "sample_id", "missing_feature_count", "boundary_feature_count", "knn_distance", "knn_outside_99", "mahalanobis_outside_99", "Craton",
        F.col("pred_class_name").alias("current_class"), F.col("pred_prob_max").alias("current_confidence"),
        F.col("Arc_probability3").alias("current_arc_probability"),
        F.col("variant_class").alias("median_impute_class"), (F.col("pred_prob_max") * 0.9).alias("median_impute_confidence"),
        (F.col("Arc_probability3") * 1.1).alias("median_impute_arc_probability"),
        F.col("variant_class").alias("nearest_class"),
        (F.col("pred_class_name") != F.col("variant_class")).alias("imputation_changed_class"),
        (F.col("sample_id") % 3 == 0).alias("normalization_changed_class"))


@register("g20_class_drift_summary",
          f"""SELECT pred_class_name AS predicted_class, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct, median(missing_feature_count) AS median_missing_count,
              median(boundary_feature_count) AS median_boundary_count, avg(pred_prob_max) AS mean_confidence, {_share('knn_outside_99', '100.0*')} AS knn_outside_99_pct,
              {_share('mahalanobis_outside_99', '100.0*')} AS mahalanobis_outside_99_pct, {_share('variant_class = pred_class_name', '100.0*')} AS nearest_class_match_pct,
              {_share('variant_class <> pred_class_name', '100.0*')} AS median_imputation_class_change_pct, {_share('sample_id % 3 = 0', '100.0*')} AS normalization_class_change_pct
              FROM E GROUP BY 1""",
          "pct median_missing_count median_boundary_count mean_confidence knn_outside_99_pct mahalanobis_outside_99_pct nearest_class_match_pct median_imputation_class_change_pct normalization_class_change_pct", "E")
def g20(spark, sf):
    return G.class_drift_summary(_drift(spark, sf))


@register("g21_source_drift_summary",
          f"""SELECT "Craton" AS source, count(*) AS n, {_share("pred_class_name = 'error'", '100.0*')} AS cfb_pct, {_share('"Arc_probability3" >= 0.5', '100.0*')} AS arc_ge_0_5_pct,
              median(missing_feature_count) AS median_missing_count, median(knn_distance) AS median_knn_distance, avg(pred_prob_max) AS mean_confidence FROM E GROUP BY 1 HAVING count(*) >= 900""",
          "cfb_pct arc_ge_0_5_pct median_missing_count median_knn_distance mean_confidence", "E")
def g21(spark, sf):
    return G.source_drift_summary(_drift(spark, sf), "Craton", "error", 900)


@register("g22_counterfactual_summary",
          """SELECT variant, count(*) FILTER (cls = 'error') AS cfb_n, 100.0*count(*) FILTER (cls = 'error')/count(*) AS cfb_pct, count(*) FILTER (arc >= 0.5) AS arc_probability_ge_0_5_n,
             avg(conf) AS mean_confidence, median(conf) AS median_confidence, 100.0*count(*) FILTER (cls = cur)/count(*) AS class_agreement_with_current_pct FROM (
             SELECT 'current' AS variant, pred_class_name AS cls, pred_prob_max AS conf, "Arc_probability3" AS arc, pred_class_name AS cur FROM E
             UNION ALL SELECT 'median_impute', variant_class, pred_prob_max*CAST(0.9 AS DOUBLE), "Arc_probability3"*CAST(1.1 AS DOUBLE), pred_class_name FROM E) t GROUP BY 1""",
          "cfb_pct mean_confidence median_confidence class_agreement_with_current_pct", "E")
def g22(spark, sf):
    return G.counterfactual_summary(_drift(spark, sf), ["current", "median_impute"], "error")


@register("g23_share_by_missing",
          f"""SELECT CASE WHEN missing_feature_count <= 0 THEN '(-1, 0]' WHEN missing_feature_count <= 5 THEN '(0, 5]' WHEN missing_feature_count <= 10 THEN '(5, 10]' WHEN missing_feature_count <= 15 THEN '(10, 15]' WHEN missing_feature_count <= 19 THEN '(15, 19]' ELSE '(19, inf)' END AS missing_bin,
              count(*) AS n, {_share("pred_class_name = 'error'", '100.0*')} AS pct FROM E GROUP BY 1""", "pct", "E")
def g23(spark, sf):
    return G.share_by_missing(scored(spark, sf), "missing_feature_count", F.col("pred_class_name") == "error")


@register("g24_ratio_summary",
          """SELECT source AS dataset, ratio, count(*) AS n_positive, median(v) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, min(v) AS min, max(v) AS max FROM (
             SELECT source, 'a/b' AS ratio, CASE WHEN m1 > 0 AND m3 > 0 THEN m1/m3 END AS v FROM S UNION ALL SELECT source, 'c/d', CASE WHEN m2 > 0 AND m4 > 0 THEN m2/m4 END FROM S) t WHERE v > 0 GROUP BY 1, 2""",
          "median q25 q75 min max", "S")
def g24(spark, sf):
    return G.ratio_summary(samples(spark, sf), "source", {"a/b": ("m1", "m3"), "c/d": ("m2", "m4")})


@register("g25_box_stats",
          """SELECT element, label, count(*) AS n, quantile_cont(v, 0.02) AS whisker_lo, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.98) AS whisker_hi, max(cap) AS cap
             FROM (SELECT 'm2' AS element, label, m2 AS v, (SELECT quantile_cont(m2, 0.998) FROM S WHERE m2 > 0) AS cap FROM S WHERE m2 > 0
                   UNION ALL SELECT 'm3', label, m3, (SELECT quantile_cont(m3, 0.998) FROM S) FROM S WHERE m3 IS NOT NULL) t GROUP BY 1, 2""",
          "whisker_lo q1 median q3 whisker_hi cap", "S")
def g25(spark, sf):
    return G.box_stats(samples(spark, sf), "label", {"m2": "log", "m3": "linear"})


@register("g26_e7_sliding_mean",
          """SELECT (2500 + 50*i)/1000.0 AS age_mid_ga, avg("Arc_probability3") AS mean_arc, count(*) AS n FROM E JOIN range(0, 31) AS g(i)
             ON "C_AGE" >= 2500 + 50*i - 100 AND "C_AGE" < 2500 + 50*i + 100 GROUP BY i HAVING count(*) >= 5""", "age_mid_ga mean_arc", "E")
def g26(spark, sf):
    return G.sliding_mean(scored(spark, sf), "C_AGE", "Arc_probability3")


@register("g27_fixed_bins",
          """SELECT w AS width, s AS shift, (lo + w/2.0)/1000.0 AS age_mid_ga, avg("Arc_probability3") AS mean_arc, count(*) AS n, median(r) AS median_ratio FROM (
             SELECT *, st + floor(("C_AGE"-st)/w)*w AS lo FROM (SELECT "C_AGE", "Arc_probability3", "BA"/nullif("TH",0) AS r, w, s, floor((SELECT min("C_AGE") FROM E)/w)*w - s AS st
             FROM E, (VALUES (100),(150),(200),(300)) AS a(w), (VALUES (0),(50),(100),(150)) AS b(s) WHERE "C_AGE" IS NOT NULL) t) u
             WHERE (lo + w/2.0)/1000.0 BETWEEN 2.5 AND 4.0 GROUP BY w, s, lo""", "age_mid_ga mean_arc median_ratio", "E")
def g27(spark, sf):
    e = scored(spark, sf).withColumn("ratio", ratio_nz("BA", "TH"))
    return G.fixed_bins(e, "C_AGE", "Arc_probability3", "ratio")


@register("g28_age_histogram",
          """SELECT (2400 + (b+0.5)*50)/1000.0 AS age_mid_ga, count("C_AGE") AS total, count(*) FILTER ("Arc_probability3" >= 0.5) AS high_arc
             FROM range(0, 32) AS g(b) LEFT JOIN E ON "C_AGE" BETWEEN 2400 AND 4000 AND least(floor(("C_AGE"-2400)/50), 31) = b GROUP BY b""", "age_mid_ga", "E")
def g28(spark, sf):
    return G.age_histogram(scored(spark, sf), "C_AGE", "Arc_probability3")


_TEXTS = {"langs": ("lang", None, None), "starts": ("head", None, None)}
_SHORT_TEXTS = {"langs": ("lang", 2, 5), "starts": ("head", 4, 6)}
_TOP = ("(SELECT src, u, list(substring(t, 1, {w}) ORDER BY c DESC, t) AS l FROM (SELECT src, u, t, count(*) AS c, row_number() OVER (PARTITION BY src, u ORDER BY count(*) DESC, t) AS r "
        "FROM (SELECT src, u, {col} AS t FROM D) q WHERE t <> '' GROUP BY src, u, t) z WHERE r <= {k} GROUP BY 1, 2)")


def _units_sql(tops, widths):
    return f"""SELECT * FROM (WITH D AS (SELECT source AS src, CASE WHEN doc_id % 4 = 0 THEN 'Unresolved' ELSE concat('zone ', CAST(doc_id % 4 AS VARCHAR)) END AS u, lang, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('head ', CAST(n_chars % 9 AS VARCHAR)) END AS head FROM documents)
              SELECT concat(n.src, '|', n.u) AS unit_id, n.src AS "SOURCE_DATASET", n.u AS current_craton, n.n AS n_samples, coalesce(a.l, []) AS langs, coalesce(b.l, []) AS starts
              FROM (SELECT src, u, count(*) AS n FROM D GROUP BY 1, 2) n LEFT JOIN {_TOP.format(w=widths[0], col='lang', k=tops[0])} a ON n.src = a.src AND n.u = a.u LEFT JOIN {_TOP.format(w=widths[1], col='head', k=tops[1])} b ON n.src = b.src AND n.u = b.u) q"""


def _unit_rows(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "source AS SOURCE_DATASET", "CASE WHEN doc_id % 4 = 0 THEN ' nan ' ELSE concat('zone  ', CAST(doc_id % 4 AS STRING)) END AS Craton", "lang",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat(' head  ', CAST(n_chars % 9 AS STRING)) END AS head")


@register("g31_build_units", _units_sql((1000000, 1000000), (1000000, 1000000)))
def g31(spark, sf):
    return G.build_units(_unit_rows(spark, sf), _TEXTS)


@register("g31_build_units_short", _units_sql((2, 4), (5, 6)))
def g31_short(spark, sf):
    return G.build_units(_unit_rows(spark, sf), _SHORT_TEXTS)


def _runs(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_type AS experiment", "user_id % 10 AS seed_no", "value").groupBy("experiment", "seed_no").agg(
        F.round(F.avg("value") / 100, 2).alias("accuracy"), F.max("value").alias("macro_f1"))


_RUNS = "(SELECT event_type AS experiment, user_id % 10 AS seed_no, round(avg(value)/100, 2) AS accuracy, max(value) AS macro_f1 FROM events GROUP BY 1, 2) r"


@register("g32_summarize_runs", f"SELECT experiment, avg(accuracy) AS accuracy_mean, stddev_samp(accuracy) AS accuracy_std, avg(macro_f1) AS macro_f1_mean, stddev_samp(macro_f1) AS macro_f1_std FROM {_RUNS} GROUP BY 1",
          "accuracy_mean accuracy_std macro_f1_mean macro_f1_std")
def g32(spark, sf):
    return G.summarize_runs(_runs(spark, sf), metrics=["accuracy", "macro_f1"])


@register("g33_best_run", f"SELECT experiment, seed_no, accuracy, macro_f1 FROM {_RUNS} QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY accuracy DESC, seed_no) = 1", "accuracy macro_f1")
def g33(spark, sf):
    return G.best_run(_runs(spark, sf))


@register("g34_report_totals",
          f"SELECT count(*) AS n, count(*) FILTER ({HIGH}) AS n_high, count(*) FILTER ({HIGH} AND {IS_ARC}) AS n_arc_high, count({BASE}) AS n_liu_samples, count(*) FILTER ({BASE}) AS n_liu_arc, count(*) FILTER ({BASE})/count({BASE}) AS ratio_liu_arc FROM E", "ratio_liu_arc", "E")
def g34(spark, sf):
    return G.report_totals(scored(spark, sf))


@register("g35_median_centres",
          """SELECT source AS dataset, pair, median(x) AS median_x, median(y) AS median_y FROM (SELECT source, 'm1|m3' AS pair, m1 AS x, m3 AS y FROM S UNION ALL SELECT source, 'm2|m4', m2, m4 FROM S) t WHERE x > 0 AND y >= 0 GROUP BY 1, 2""",
          "median_x median_y", "S")
def g35(spark, sf):
    return G.median_centres(samples(spark, sf), "source", [("m1", "m3"), ("m2", "m4")])


@register("g36_label_crosscheck", "SELECT \"Craton\", count(*) AS n, count(*) FILTER (\"Arc_probability3\" >= 0.5) AS high_arc_n FROM E WHERE \"Craton\" IN ('unit 3','unit 4') GROUP BY 1", views="E")
def g36(spark, sf):
    e = scored(spark, sf).withColumn("h", F.col("Arc_probability3") >= 0.5)
    return G.label_crosscheck(e, "Craton", ["unit 3", "unit 4"], "h")


_Z = """SELECT t, x, CASE WHEN mad > 0 THEN (x-m)/(1.4826*mad) ELSE (x-m)/coalesce(nullif(sd,0),1) END AS z FROM (
  SELECT t, x, m, sd, median(abs(x-m)) OVER () AS mad FROM (SELECT t, x, median(x) OVER () AS m, stddev_pop(x) OVER () AS sd FROM ({src}) a) b) c"""


@register("h8_robust_z", _Z.format(src="SELECT mid AS t, avg(\"BA\") AS x FROM B GROUP BY 1"), "x z", "E B")
def h8(spark, sf):
    means = binned(spark, sf).where("age_bin IS NOT NULL").groupBy(F.col("age_bin.mid").alias("t")).agg(F.avg("BA").alias("x"))
    return G.robust_z(means, "x")


@register("h8_robust_z_log", _Z.format(src="SELECT mid AS t, log10(avg(\"BA\")) AS x FROM B GROUP BY 1"), "x z", "E B")
def h8b(spark, sf):
    means = binned(spark, sf).where("age_bin IS NOT NULL").groupBy(F.col("age_bin.mid").alias("t")).agg(F.avg("BA").alias("v"))
    return G.robust_z(means, "v", log=True).select("t", F.log10("v").alias("x"), "z")


@register("c28_c29_high_arc_flags",
          """SELECT sample_id, pred_class_name IN ('click','view') OR coalesce("Arc_probability3" >= 0.5, FALSE) AS high_arc,
             is_arc_related_9class AND pred_prob_max >= 0.7 AND pred_prob_std <= 0.05 AS high_arc_map FROM E""", views="E")
def c28(spark, sf):
    return R.high_arc_map(R.high_arc(scored(spark, sf), ARC)).select("sample_id", "high_arc", "high_arc_map")


# --- grids over age ---------------------------------------------------------------------------

_SHARES = "(SELECT pred_class_name, mid/1000.0 AS x, count(*)/sum(count(*)) OVER (PARTITION BY mid) AS y FROM B GROUP BY pred_class_name, mid)"
_STEP = "(4.0-2.5)/519.0"
_INTERP = f"""(SELECT k.pred_class_name, g.i, CAST(2.5 + g.i*{_STEP} AS DOUBLE) AS grid, coalesce(max(s.y + CASE WHEN nx IS NULL THEN 0 ELSE (ny - s.y)*(2.5 + g.i*{_STEP} - s.x)/(nx - s.x) END), 0.0) AS value
  FROM (SELECT DISTINCT pred_class_name FROM B) k CROSS JOIN range(0, 520) AS g(i)
  LEFT JOIN (SELECT *, lead(x) OVER (PARTITION BY pred_class_name ORDER BY x) AS nx, lead(y) OVER (PARTITION BY pred_class_name ORDER BY x) AS ny FROM {_SHARES} q) s
  ON s.pred_class_name = k.pred_class_name AND s.x <= 2.5 + g.i*{_STEP} AND 2.5 + g.i*{_STEP} < coalesce(nx, s.x + 1e-12) GROUP BY 1, 2)"""


def _shares(spark, sf):
    wide = G.class_by_bin(binned(spark, sf), CLASSES)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("pred_class_name"), F.col(f"ratio_{c}").alias("y")) for c in CLASSES]))
    return wide.select((F.col("age_bin_mid_ma") / 1000.0).alias("x"), cells.alias("c")).select("x", "c.*")


@register("h12_interp_grid", f"SELECT pred_class_name, CAST(i AS INTEGER) AS i, grid, value FROM {_INTERP} t", "grid value", "E B")
def h12(spark, sf):
    return U.interp_grid(_shares(spark, sf), ["pred_class_name"], "x", "y", 2.5, 4.0, 520)


_SMOOTH = f"""(SELECT a.pred_class_name, a.i, sum(b.value*exp(-0.5*(o/12.0)*(o/12.0)))/sum(exp(-0.5*(o/12.0)*(o/12.0))) AS value
  FROM {_INTERP} a CROSS JOIN range(-36, 37) AS g(o) JOIN {_INTERP} b ON a.pred_class_name = b.pred_class_name AND b.i = greatest(0, least(519, a.i + o)) GROUP BY 1, 2)"""


@register("h13_smooth_grid", f"SELECT pred_class_name, CAST(i AS INTEGER) AS i, value FROM {_SMOOTH} t", "value", "E B")
def h13(spark, sf):
    grid = U.interp_grid(_shares(spark, sf), ["pred_class_name"], "x", "y", 2.5, 4.0, 520)
    return U.smooth_grid(grid, ["pred_class_name"])


@register("m8_ridge_profiles", f"SELECT pred_class_name, CAST(i AS INTEGER) AS i, value*0.78/max(value) OVER () AS value FROM {_SMOOTH} t", "value", "E B")
def m8(spark, sf):
    return U.ridge_profiles(_shares(spark, sf), "pred_class_name", "x", "y", 2.5, 4.0)
