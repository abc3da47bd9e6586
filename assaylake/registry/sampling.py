"""Seeded sampling, splits, folds, weights, quantile codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as Y
from ..operators import encode as X
from ..operators import impute as I
from ..operators import sampling as Z
from ..operators import summaries as G
from .frames import SEED, hash_sql, register, samples, scored, table

ID = "sample_id"


def _ranked(seed: int, part: str = "", source: str = "S", key: str = ID) -> str:
    over = f"PARTITION BY {part} " if part else ""
    return (f"SELECT *, row_number() OVER ({over}ORDER BY {hash_sql(seed, key)}, {key}) AS r, "
            f"count(*) OVER ({'PARTITION BY ' + part if part else ''}) AS c, count(*) OVER () AS total FROM {source}")


@register("h1_cap_per_label", f"SELECT sample_id, label FROM ({_ranked(SEED, 'label')}) t WHERE r <= 5000", views="S")
def h1(spark, sf):
    return Z.cap_per_label(samples(spark, sf), "label", 5000, SEED, ID).select(ID, "label")


@register("h2_undersample_one_label",
          f"SELECT sample_id, label FROM S WHERE label <> 'R' UNION ALL SELECT sample_id, label FROM ({_ranked(SEED, source=chr(40) + 'SELECT * FROM S WHERE label = ' + chr(39) + 'R' + chr(39) + ') q')}) t WHERE r <= 6920", views="S")
def h2(spark, sf):
    return Z.undersample(samples(spark, sf), "label", "R", 6920, SEED, ID).select(ID, "label")


@register("h3_sample_n", f"SELECT sample_id FROM ({_ranked(7)}) t WHERE r <= 9000", views="S")
def h3(spark, sf):
    return Z.sample_n(samples(spark, sf), 9000, 7, ID).select(ID)


@register("h4_stratified_by_bin",
          f"""SELECT sample_id FROM (
            WITH W AS (SELECT *, least(floor((m2-lo)/((hi-lo)/24.0)), 23) AS b FROM S, (SELECT min(m2) lo, max(m2) hi FROM S WHERE m3 IS NOT NULL) x WHERE m3 IS NOT NULL),
            K AS (SELECT b, count(*) AS c, sum(count(*)) OVER () AS n, 3000 - count(*) OVER () AS spare FROM W GROUP BY b),
            J AS (SELECT *, c/n*spare AS want FROM K),
            L AS (SELECT *, spare - sum(floor(want)) OVER () AS left_over, row_number() OVER (ORDER BY want - floor(want) DESC, b DESC) AS o FROM J),
            U AS (SELECT b, least(1 + floor(want) + CASE WHEN o <= left_over THEN 1 ELSE 0 END, c) AS quota FROM L)
            SELECT sample_id FROM (SELECT W.*, quota, row_number() OVER (PARTITION BY W.b ORDER BY {hash_sql(11)}, sample_id) AS r FROM W JOIN U ON W.b = U.b) t WHERE r <= quota) z""", views="S")
def h4(spark, sf):
    return Z.stratified_sample_by_bin(samples(spark, sf), "m2", "m3", 3000, 24, 11, ID).select(ID)


@register("h5_proportional_sample", f"SELECT sample_id, p_brand FROM ({_ranked(5, 'p_brand', '(SELECT p_partkey AS sample_id, p_brand FROM part) q')}) t WHERE r <= greatest(1, floor(90*c/total))")
def h5(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias(ID), "p_brand")
    return Z.proportional_sample(p, "p_brand", 90, 5, ID)


@register("h6_quota_sample", f"SELECT sample_id, label FROM ({_ranked(SEED, 'label')}) t WHERE r <= CASE label WHEN 'A' THEN 200 WHEN 'N' THEN 250 ELSE 300 END", views="S")
def h6(spark, sf):
    return Z.quota_sample(samples(spark, sf), "label", {"A": 200, "N": 250}, 300, SEED, ID).select(ID, "label")


@register("h6_quota_sample_in_band",
          f"""SELECT sample_id, label FROM ({_ranked(SEED, 'label', "(SELECT S.* FROM S LEFT JOIN (SELECT 'A' AS label, quantile_cont(m2, 0.1) AS lo, quantile_cont(m2, 0.6) AS hi FROM S WHERE label = 'A') q ON S.label = q.label WHERE lo IS NULL OR m2 BETWEEN lo AND hi) w")}) t WHERE r <= 300""", views="S")
def h6b(spark, sf):
    return Z.quota_sample(samples(spark, sf), "label", {}, 300, SEED, ID, {"A": ("m2", 0.1, 0.6)}).select(ID, "label")


@register("h7_factorize",
          "SELECT p_partkey, p_brand, idx AS label_idx FROM part JOIN (SELECT p_brand, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) AS idx FROM part GROUP BY 1) i USING (p_brand)")
def h7(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return Z.factorize(p, "p_brand", "p_partkey", Z.label_index(p, "p_brand", "p_partkey"))


@register("h9_top_k", "SELECT p_brand, avg(p_retailprice) AS score, CAST(row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_brand) AS INTEGER) AS rank FROM part GROUP BY 1 QUALIFY rank <= 8", "score")
def h9(spark, sf):
    scores = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("score"))
    return G.top_k(scores, "score", 8, tie="p_brand")


@register("h9_order_by_group",
          "SELECT p_brand, avg(p_retailprice) AS score, CASE WHEN p_brand IN ('Brand#3','Brand#4') THEN 'first' WHEN p_brand IN ('Brand#1') THEN 'second' END AS \"group\", "
          "CAST(CASE WHEN p_brand IN ('Brand#3','Brand#4') THEN 0 WHEN p_brand IN ('Brand#1') THEN 1 ELSE 2 END AS INTEGER) AS group_rank FROM part GROUP BY 1", "score")
def h9b(spark, sf):
    scores = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("score"))
    return G.order_by_group(scores, "p_brand", "score", {"first": ["Brand#3", "Brand#4"], "second": ["Brand#1"]})


def _exact_split(test: float, val: float) -> str:
    held = (f"SELECT label, c, want - floor(want) AS frac, floor(want) AS base, goal FROM (SELECT label, c, goal, c*goal/n AS want FROM "
            f"(SELECT label, count(*) AS c, sum(count(*)) OVER () AS n, ceil(sum(count(*)) OVER () * {test + val}) AS goal FROM S GROUP BY label) a) b")
    held = f"SELECT label, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, label) <= goal - sum(base) OVER () THEN 1 ELSE 0 END AS held FROM ({held}) q"
    if not val:
        return f"SELECT label, held, held AS test FROM ({held}) h"
    inner = (f"SELECT label, held, want - floor(want) AS frac, floor(want) AS base, goal FROM (SELECT label, held, goal, held*goal/n AS want FROM "
             f"(SELECT label, held, sum(held) OVER () AS n, ceil(sum(held) OVER () * {test / (test + val)}) AS goal FROM ({held}) h) a) b")
    return f"SELECT label, held, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, label) <= goal - sum(base) OVER () THEN 1 ELSE 0 END AS test FROM ({inner}) q"


def _split_sql(test: float, val: float) -> str:
    return (f"SELECT sample_id, label, CASE WHEN r <= test THEN 'test' WHEN r <= held THEN 'val' ELSE 'train' END AS split "
            f"FROM ({_ranked(32, 'label')}) t JOIN ({_exact_split(test, val)}) u USING (label)")


@register("i1_stratified_split", _split_sql(0.2, 0.0), views="S")
def i1(spark, sf):
    return Z.stratified_split(samples(spark, sf), "label", 0.2).select(ID, "label", "split")


@register("i1_train_val_test", _split_sql(0.2, 0.1), views="S")
def i1b(spark, sf):
    return Z.stratified_split(samples(spark, sf), "label", 0.2, 0.1).select(ID, "label", "split")


@register("g4_split_summary",
          f"SELECT split, label, count(*) AS count, count(*)*100.0/sum(count(*)) OVER (PARTITION BY split) AS percent FROM ({_split_sql(0.2, 0.0)}) z GROUP BY split, label", "percent", "S")
def g4(spark, sf):
    return Z.split_summary(Z.stratified_split(samples(spark, sf), "label", 0.2), "label", digits=6)


@register("i2_clamped_split",
          f"SELECT sample_id, p_brand, CASE WHEN c > 1 AND r <= greatest(1, least(c-1, round_even(c*0.2, 0))) THEN 'test' ELSE 'train' END AS split FROM ({_ranked(SEED, 'p_brand', '(SELECT p_partkey AS sample_id, p_brand FROM part) q')}) t")
def i2(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias(ID), "p_brand")
    return Z.stratified_split(p, "p_brand", 0.2, seed=SEED, rule="clamp").select(ID, "p_brand", "split")


@register("i3_stratified_folds", f"SELECT sample_id, label, CAST((r-1) % 5 AS INTEGER) AS fold FROM ({_ranked(32, 'label')}) t", views="S")
def i3(spark, sf):
    return Z.stratified_folds(samples(spark, sf), "label", 5, 32, ID).select(ID, "label", "fold")


@register("i5_sampling_strategy",
          "SELECT event_type AS label, 5000 AS target, count(*) AS n FROM events WHERE event_type IN ('view','click') GROUP BY 1 HAVING count(*) < 5000")
def i5(spark, sf):
    counts = {r[0]: r[1] for r in table(spark, sf, "events").groupBy("event_type").count().collect()}
    plan = Y.sampling_strategy(counts, Y.parse_targets("view=5000\nclick = 5000\n"))
    return spark.createDataFrame([(k, t, counts[k]) for k, t in plan.items()], "label string, target int, n bigint")


@register("i9_class_weights",
          "SELECT event_type, count, w/avg(w) OVER () AS weight FROM (SELECT event_type, count(*) AS count, sum(count(*)) OVER ()/(count(*) OVER () * count(*)) AS w FROM events GROUP BY 1) t", "weight")
def i9(spark, sf):
    return Z.class_weights(table(spark, sf, "events"), "event_type")


# --- quantile codes ---------------------------------------------------------------------------

_BOUNDS = {
    c: (f"(SELECT list(v ORDER BY r) FROM (SELECT r, v FROM range(1, 255) AS g(r), "
        f"(SELECT list({c} ORDER BY {c}) AS vs, count({c}) AS n FROM S WHERE {c} IS NOT NULL AND source = 'F') q, "
        f"LATERAL (SELECT vs[least(CAST(round_even(n*r/255.0, 0) AS BIGINT), n-1) + 1] AS v) w) z)")
    for c in ("m2", "m3")
}


@register("g6_fit_boundaries",
          " UNION ALL ".join(f"SELECT '{c}' AS feature, {b} AS boundaries" for c, b in _BOUNDS.items()), views="S")
def g6(spark, sf):
    return X.fit_boundaries(samples(spark, sf).where("source = 'F'"), ["m2", "m3"])


@register("g7_fit_boundaries_linear",
          "SELECT feature, CAST(r AS INTEGER) AS r, b[r] AS boundary FROM (SELECT 'm2' AS feature, quantile_cont(m2, [" +
          ",".join(f"{r}/20.0" for r in range(1, 20)) + "]) AS b FROM S UNION ALL SELECT 'm4', quantile_cont(m4, [" +
          ",".join(f"{r}/20.0" for r in range(1, 20)) + "]) FROM S) t, range(1, 20) AS g(r)", "boundary", "S")
def g7(spark, sf):
    fit = X.fit_boundaries_linear(samples(spark, sf), ["m2", "m4"], 20)
    return fit.select("feature", F.posexplode("boundaries").alias("r", "boundary")).withColumn("r", F.col("r") + 1)


def _encoded(spark, sf, rule):
    s = samples(spark, sf)
    params = X.collect_boundaries(X.fit_boundaries(s.where("source = 'F'"), ["m2", "m3"]))
    return X.quantile_encode(s.where("source = 'O'").select(ID, "label", "m2", "m3"), params, rule)


_CODE_SQL = ("WITH W AS (SELECT {b2} AS b2, {b3} AS b3) SELECT sample_id, label, "
             "CAST(greatest(1, least(255, 1 + len(list_filter(b2, lambda b: b < m2)))) AS SMALLINT) AS m2, "
             "CASE WHEN m3 IS NULL THEN {empty} ELSE CAST(greatest(1, least(255, 1 + len(list_filter(b3, lambda b: b < m3)))) AS SMALLINT) END AS m3 "
             "FROM S, W WHERE source = 'O'")


def _codes(empty: str) -> str:
    return f"SELECT * FROM ({_CODE_SQL.format(b2=_BOUNDS['m2'], b3=_BOUNDS['m3'], empty=empty)}) c"


@register("j8_encode_null_zero", _codes("CAST(0 AS SMALLINT)"), views="S")
def j8(spark, sf):
    return _encoded(spark, sf, "zero")


@register("j8_encode_null_kept", _codes("NULL"), views="S")
def j8b(spark, sf):
    return _encoded(spark, sf, "null")


@register("g8_boundary_share",
          f"""SELECT 'm2' AS feature, 100.0*count(*) FILTER (m2 IN (1,255))/count(*) AS boundary_pct FROM ({_codes('CAST(0 AS SMALLINT)')}) x
              UNION ALL SELECT 'm3', 100.0*count(*) FILTER (m3 IN (1,255))/count(*) FROM ({_codes('CAST(0 AS SMALLINT)')}) x
              UNION ALL SELECT 'all', 100.0*(count(*) FILTER (m2 IN (1,255)) + count(*) FILTER (m3 IN (1,255)))/(2*count(*)) FROM ({_codes('CAST(0 AS SMALLINT)')}) x""",
          "boundary_pct", "S")
def g8(spark, sf):
    coded = _encoded(spark, sf, "zero")
    total = X.boundary_share(coded, ["m2", "m3"]).select(F.lit("all").alias("feature"), "boundary_pct")
    return X.boundary_share(coded, ["m2", "m3"], "feature").unionByName(total)


@register("g8_boundary_count_per_row",
          f"SELECT sample_id, CAST(m2 IN (1,255) AS INTEGER) + CAST(m3 IN (1,255) AS INTEGER) AS boundary_feature_count FROM ({_codes('CAST(0 AS SMALLINT)')}) x", views="S")
def g8b(spark, sf):
    return X.boundary_share(_encoded(spark, sf, "zero"), ["m2", "m3"], "row", id_col=ID)


@register("j7_missing_mask",
          "SELECT sample_id, CAST(m3 IS NULL OR m3-2 <= 0 AS TINYINT) AS missing_mask__m3, CAST(m4 IS NULL OR m4-2 <= 0 AS TINYINT) AS missing_mask__m4 FROM S", views="S")
def j7(spark, sf):
    s = samples(spark, sf).withColumns({"m3": F.col("m3") - 2, "m4": F.col("m4") - 2})
    return X.missing_mask(s, ["m3", "m4"], "null_or_nonpositive", [ID])


@register("j1_standard_scaler",
          "SELECT sample_id, (m1-a1)/s1 AS m1, (m3-a3)/s3 AS m3, (m1-a1)/s1*s1+a1 AS back FROM S, (SELECT avg(m1) a1, stddev_pop(m1) s1, avg(m3) a3, stddev_pop(m3) s3 FROM S WHERE source = 'F') q", "m1 m3 back", "S")
def j1(spark, sf):
    s = samples(spark, sf)
    scaler = I.fit_scaler(s.where("source = 'F'"), ["m1", "m3"])
    scaled = I.scale(s, scaler)
    back = I.unscale(scaled, scaler, clip=True).select(ID, F.col("m1").alias("back"))
    return scaled.select(ID, "m1", "m3").join(back, ID)


@register("j9_median_impute",
          "SELECT sample_id, CASE WHEN m3 IS NULL OR m3 <= 0 THEN d3 ELSE m3 END AS m3, CASE WHEN m4 IS NULL OR m4 <= 0 THEN d4 ELSE m4 END AS m4 FROM S, (SELECT median(m3) d3, median(m4) d4 FROM S WHERE source = 'F') q WHERE source = 'O'", "m3 m4", "S")
def j9(spark, sf):
    s = samples(spark, sf)
    return I.median_impute(s.where("source = 'F'"), s.where("source = 'O'"), ["m3", "m4"]).select(ID, "m3", "m4")


# --- imputation and oversampling (no SQL twin; checked by invariants in the tests) -------------

_FEW = I.ForestParams(trees=5, max_depth=5, parallel_fits=3)


@register("j2_j3_j4_forest_impute")
def j2(spark, sf):
    s = samples(spark, sf).select(ID, "label", "m1", "m2", "m3", "m4")
    return I.impute(s, I.fit_imputer(s, ["m1", "m2", "m3", "m4"], _FEW))


@register("j5_j6_forest_impute_unchained")
def j5(spark, sf):
    s = samples(spark, sf).select(ID, "label", "m1", "m2", "m3", "m4")
    params = I.ForestParams(trees=5, max_depth=5, parallel_fits=3, chained=False, indicators=True)
    return I.impute(s, I.fit_imputer(s, ["m1", "m2", "m3", "m4"], params, standardize=False))


def _classes(spark, sf):
    e = scored(spark, sf)
    return e.select(ID, F.col("pred_class_name").alias("label"), "BA", "TH", "LA", "user_id")


def _targets(spark, sf, factor):
    counts = {r[0]: r[1] for r in _classes(spark, sf).groupBy("label").count().collect()}
    return {k: int(counts[k] * factor) for k in ("view", "click")}


@register("i4_i8_smote",
          "SELECT label, is_synthetic, CASE WHEN is_synthetic THEN CAST(floor(n*1.25) AS BIGINT) - n ELSE n END AS n, CASE WHEN is_synthetic THEN 0 ELSE u END AS n_metadata, TRUE AS non_negative "
          "FROM (SELECT event_type AS label, count(*) AS n, count(user_id) AS u FROM events GROUP BY 1) t, (VALUES (TRUE), (FALSE)) AS f(is_synthetic) WHERE NOT is_synthetic OR label IN ('view','click')")
def i4(spark, sf):
    out = Y.smote(_classes(spark, sf), ["BA", "TH", "LA"], "label", _targets(spark, sf, 1.25))
    return out.groupBy("label", "is_synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.count("user_id").alias("n_metadata"),
        F.min((F.least("BA", "TH", "LA") >= 0)).alias("non_negative"))


@register("i6_i7_smote_scaled_targets",
          "SELECT event_type AS label, count(*) + CASE WHEN event_type IN ('view','click') THEN CAST(round_even(floor(count(*)*2.5)*0.5, 0) AS BIGINT) - count(*) ELSE 0 END AS n FROM events GROUP BY 1")
def i6(spark, sf):
    targets = Y.fold_targets(_targets(spark, sf, 2.5), 1, 2)
    return Y.smote(_classes(spark, sf), ["BA", "TH", "LA"], "label", targets, standardize=False).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))


