"""Predictions, classifier evaluation and attribution summaries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import attribution as L
from ..operators import evaluate as V
from ..operators import score as R
from .domain import ARC_CLASSES, NAMES
from .frames import probabilities, register, shap_long, shares_sql, SquareShares, table


def _eval(spark, sf):
    return probabilities(spark, sf).withColumn("pred", R.predicted_index("probs"))


_SLUGS = [R.class_slug(n) for n in NAMES]


@register("c27_prediction_columns",
          "SELECT vec_id, pred AS pred_class_idx, concat('class ', CAST(pred AS VARCHAR)) AS pred_class_name, conf AS pred_prob_max, 0.1*conf AS pred_prob_std, pred <= 2 AS is_arc_related_9class, "
          "CASE WHEN conf >= 0.12 AND 0.1*conf <= 0.05 THEN 'high' WHEN conf >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_tier, conf >= 0.12 AND 0.1*conf <= 0.05 AS is_high_confidence, "
          "0.0 + probs[1] + probs[2] + probs[3] AS \"Arc_probability3\", CASE WHEN label <> 4 THEN label*0.1 >= 0.5 END AS liu_arc_binary, " +
          ", ".join(f"probs[{i + 1}] AS prob_{s}, 0.1*probs[{i + 1}] AS prob_std_{s}" for i, s in enumerate(_SLUGS)) + " FROM Q",
          "pred_prob_max pred_prob_std Arc_probability3 " + " ".join(f"prob_{s} prob_std_{s}" for s in _SLUGS), "P")
def c27(spark, sf):
    p = probabilities(spark, sf).withColumns({
        "stds": F.transform("probs", lambda x: F.lit(0.1) * x),
        "outside": F.expr("CASE WHEN label <> 4 THEN cast(label*0.1 AS string) ELSE 'none' END")})
    out = R.add_prediction_columns(p, "probs", NAMES, "stds", ARC_CLASSES, high_p=0.12, baseline="outside")
    return out.drop("vec", "probs", "stds", "outside", "label")


_GRID = "range(10) AS a(y_true), range(10) AS b(y_pred)"
_CONF = f"""(SELECT CAST(g.y_true AS INTEGER) AS y_true, CAST(g.y_pred AS INTEGER) AS y_pred, count(vec_id) AS n FROM (SELECT * FROM {_GRID}) g
  LEFT JOIN Q ON label = g.y_true AND pred = g.y_pred GROUP BY 1, 2)"""
_PER = f"""(SELECT c AS class, coalesce(h/nullif(q,0),0.0) AS precision, coalesce(h/nullif(s,0),0.0) AS recall, coalesce(2.0*h/nullif(s+q,0),0.0) AS f1, s AS support, q AS predicted, h AS hits FROM (
  SELECT CAST(c AS INTEGER) AS c, count(*) FILTER (label = c) AS s, count(*) FILTER (pred = c) AS q, count(*) FILTER (label = c AND pred = c) AS h FROM Q, range(10) AS g(c) GROUP BY 1) t)"""


@register("k1_confusion", f"SELECT *, coalesce(100.0*n/nullif(sum(n) OVER (PARTITION BY y_true), 0), 0.0) AS row_pct FROM {_CONF} c", "row_pct", "P")
def k1(spark, sf):
    return V.confusion(_eval(spark, sf), "label", "pred", 10)


@register("k2_class_metrics",
          f"SELECT sum(hits)/sum(support) AS accuracy, sum(precision*support)/sum(support) AS precision, sum(recall*support)/sum(support) AS recall, sum(f1*support)/sum(support) AS weighted_f1, avg(f1) AS macro_f1 FROM {_PER} p WHERE support > 0 OR predicted > 0",
          "accuracy precision recall weighted_f1 macro_f1", "P")
def k2(spark, sf):
    return V.class_metrics(V.confusion(_eval(spark, sf), "label", "pred", 10))


@register("k2_per_class_metrics", f"SELECT * FROM {_PER} p", "precision recall f1", "P")
def k2b(spark, sf):
    return V.per_class_metrics(V.confusion(_eval(spark, sf), "label", "pred", 10))


_RUN = """(SELECT class, score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY class) AS tp, sum(neg) OVER (PARTITION BY class) AS tn FROM (
  SELECT {key} AS class, probs[c+1] AS score, CAST(sum(CAST(label = c AS INTEGER)) AS DOUBLE) AS pos, CAST(sum(CAST(label <> c AS INTEGER)) AS DOUBLE) AS neg FROM P, range(10) AS g(c) GROUP BY 1, 2) t
  WINDOW w AS (PARTITION BY class ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("k3_average_precision", f"SELECT CAST(class AS INTEGER) AS class, coalesce(sum(pos/nullif(tp,0)*cp/(cp+cn)), 0.0) AS ap FROM {_RUN.format(key='c')} r GROUP BY 1", "ap", "P")
def k3(spark, sf):
    return V.average_precision(probabilities(spark, sf), "label", "probs")


@register("k3_mean_ap", f"SELECT avg(ap) AS map_macro FROM (SELECT class, coalesce(sum(pos/nullif(tp,0)*cp/(cp+cn)), 0.0) AS ap FROM {_RUN.format(key='c')} r GROUP BY 1) t", "map_macro", "P")
def k3b(spark, sf):
    return V.mean_ap(probabilities(spark, sf), "label", "probs")


@register("k4_micro_curves", f"SELECT score, cn/tn AS fpr, cp/tp AS tpr, cp/(cp+cn) AS precision FROM {_RUN.format(key='0')} r", "score fpr tpr precision", "P")
def k4(spark, sf):
    return V.micro_roc_pr(probabilities(spark, sf), "label", "probs")[0]


@register("k4_micro_auc", f"SELECT sum(neg*(cp-pos/2.0))/(max(tp)*max(tn)) AS micro_auc, sum(pos*cp/(cp+cn))/max(tp) AS micro_ap FROM {_RUN.format(key='0')} r", "micro_auc micro_ap", "P")
def k4b(spark, sf):
    return V.micro_roc_pr(probabilities(spark, sf), "label", "probs")[1]


@register("k5_log_loss", "SELECT avg(-ln(greatest(least(probs[label+1]/list_sum(probs), 1-2.220446049250313e-16), 2.220446049250313e-16))) AS log_loss FROM P", "log_loss", "P")
def k5(spark, sf):
    return V.log_loss(probabilities(spark, sf), "label", "probs")


@register("k6_ece",
          "SELECT sum(n*abs(acc-cf))/sum(n) AS ece FROM (SELECT ceil(conf*10) AS b, count(*) AS n, avg(CAST(pred = label AS INTEGER)) AS acc, avg(conf) AS cf FROM Q GROUP BY 1) t", "ece", "P")
def k6(spark, sf):
    return V.ece(probabilities(spark, sf), "label", "probs")


_CURVE = """(SELECT i*(0.999::DOUBLE/399) AS threshold, count(vec_id)/(SELECT count(*) FROM Q) AS coverage, CASE WHEN count(vec_id) >= greatest(10, floor((SELECT count(*) FROM Q)*0.01)) THEN avg(CAST(pred = label AS INTEGER)) END AS accuracy
  FROM range(400) AS g(i) LEFT JOIN Q ON conf >= i*(0.999::DOUBLE/399) GROUP BY i)"""


@register("k7_coverage_accuracy", f"SELECT * FROM {_CURVE} c", "threshold coverage accuracy", "P")
def k7(spark, sf):
    return V.coverage_accuracy(probabilities(spark, sf), "label", "probs")


@register("k7_recommended_threshold",
          f"SELECT * FROM {_CURVE} c WHERE accuracy IS NOT NULL ORDER BY CASE WHEN accuracy >= 0.05 AND coverage >= 0.05 THEN 0 ELSE 1 END, CASE WHEN accuracy >= 0.05 AND coverage >= 0.05 THEN -threshold ELSE -accuracy END, threshold LIMIT 1", "threshold coverage accuracy", "P")
def k7b(spark, sf):
    return V.recommended_threshold(V.coverage_accuracy(probabilities(spark, sf), "label", "probs"), target=0.05)


@register("k8_overconfidence", "SELECT count(*) AS n_confident, 1.0 - avg(CAST(pred = label AS INTEGER)) AS error_rate FROM Q WHERE conf >= 0.12", "error_rate", "P")
def k8(spark, sf):
    return V.overconfidence(probabilities(spark, sf), "label", "probs", 0.12)


@register("k8_confident_outside", "SELECT count(*) FILTER (conf >= 0.12 AND vec_id % 3 = 0) AS n_confident_outside FROM Q", views="P")
def k8b(spark, sf):
    p = probabilities(spark, sf).select(F.array_max("probs").alias("conf"), (F.col("vec_id") % 3 == 0).alias("out"))
    return V.confident_outside(p, "conf", "out", 0.12)


# --- model input, scoring, baselines ----------------------------------------------------------


_DIMS = 64
_ORDER = [2, 0, 1, *range(3, _DIMS)]


def _codes(spark, sf):
    p = table(spark, sf, "embeddings")
    cells = {f"f{i}": F.pmod(F.floor(F.get("embedding", i).cast("double") * 1000), F.lit(256)).cast("smallint") for i in range(_DIMS)}
    masks = {f"missing_mask__f{i}": (F.get("embedding", i) < 0).cast("tinyint") for i in range(_DIMS)}
    return p.withColumns({**cells, **masks}).withColumn("label", F.col("label").cast("double"))


@register("j19_model_vector",
          "SELECT vec_id, [" + ", ".join(f"CAST(((CAST(floor(CAST(embedding[{i + 1}] AS DOUBLE)*1000) AS BIGINT) % 256) + 256) % 256 AS DOUBLE)/255.0" for i in _ORDER) + ", " +
          ", ".join(f"CAST(CAST(embedding[{i + 1}] < 0 AS INTEGER) AS DOUBLE)" for i in _ORDER) + "] AS features FROM embeddings")
def j19(spark, sf):
    return R.model_vector(_codes(spark, sf), [f"f{i}" for i in _ORDER]).select("vec_id", vector_to_array("features").alias("features"))


def _fitted(spark, sf, name, **settings):
    rows = R.model_vector(_codes(spark, sf), [f"f{i}" for i in range(_DIMS)])
    return rows, R.baseline(name, n_features=2 * _DIMS, n_classes=10, **settings).fit(rows.where("vec_id % 2 = 0"))


@register("j20_score_two_models", "SELECT vec_id, 10 AS n_classes, CAST(1.0 AS DOUBLE) AS total, TRUE AS std_ok FROM embeddings", "total")
def j20(spark, sf):
    rows, one = _fitted(spark, sf, "random_forest", numTrees=5, maxDepth=4, minInstancesPerNode=1)
    _, two = _fitted(spark, sf, "random_forest", numTrees=5, maxDepth=4, minInstancesPerNode=1, seed=7)
    out = R.score(rows, [one, two])
    return out.select("vec_id", F.size("probs").alias("n_classes"), F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("total"),
                      F.forall("probs_std", lambda x: x >= 0).alias("std_ok"))


_CELLS = [f"CAST(((CAST(floor(CAST(embedding[{i + 1}] AS DOUBLE)*1000) AS BIGINT) % 256) + 256) % 256 AS DOUBLE)/255.0" for i in range(_DIMS)] + \
    [f"CAST(CAST(embedding[{i + 1}] < 0 AS INTEGER) AS DOUBLE)" for i in range(_DIMS)]
_SHARES = [f"{part}{c}" for part in "ps" for c in range(10)]


@register("j20_score_values",
          "SELECT vec_id, " + ", ".join(_SHARES) + " FROM (" + shares_sql([f"x[{i + 1}]" for i in range(2 * _DIMS)], 10, (1, 2)).format(
              source="(SELECT vec_id, [" + ", ".join(_CELLS) + "] AS x FROM embeddings) e") + ") t", " ".join(_SHARES))
def j20b(spark, sf):
    """Mean and deviation of two classifiers whose shares SQL can state, on all codes and masks."""
    rows = R.model_vector(_codes(spark, sf), [f"f{i}" for i in range(_DIMS)])
    out = R.score(rows, [SquareShares(tuple(map(float, range(10))), 2 * _DIMS, turn) for turn in (1, 2)])
    return out.select("vec_id", *[F.get("probs", c).alias(f"p{c}") for c in range(10)], *[F.get("probs_std", c).alias(f"s{c}") for c in range(10)])


@register("j21_baselines", "SELECT name, count(*) AS n FROM embeddings, (VALUES ('random_forest'), ('linear_svm'), ('boosted_trees'), ('mlp')) AS v(name) WHERE vec_id % 2 = 1 GROUP BY 1")
def j21(spark, sf):
    small = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "linear_svm": {"maxIter": 3}, "boosted_trees": {"maxIter": 2, "maxDepth": 2}, "mlp": {"maxIter": 5}}
    parts = []
    for name, settings in small.items():
        rows, model = _fitted(spark, sf, name, **settings)
        parts.append(model.transform(rows.where("vec_id % 2 = 1")).select(F.lit(name).alias("name"), "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("prediction BETWEEN 0 AND 9").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@register("j21_rbf_machine")
def j21b(spark, sf):
    """All 64 dimensions, production parameters, fitted on the even rows; every row is predicted."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("features"), F.col("label").cast("double").alias("label"))
    out = R.baseline("svm").fit(rows.where("vec_id % 2 = 0")).transform(rows)
    return out.select("vec_id", F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("probs"))


@register("j21_softmax_boosting")
def j21c(spark, sf):
    """All 64 dimensions and default settings but for 20 of 200 rounds, fitted on the even rows; every row is predicted."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("features"), F.col("label").cast("double").alias("label"))
    out = R.baseline("softmax_boosting", rounds=20).fit(rows.where("vec_id % 2 = 0")).transform(rows)
    return out.select("vec_id", F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("probs"))


# --- attribution ------------------------------------------------------------------------------


@register("l1_mean_abs_shap", "SELECT feature, " + ", ".join(f"avg(abs(shap)) FILTER (class = {c}) AS class_{c}" for c in range(4)) + ", avg(abs(shap)) AS overall FROM H GROUP BY 1",
          "class_0 class_1 class_2 class_3 overall", "P H")
def l1(spark, sf):
    return L.mean_abs_shap(shap_long(spark, sf), range(4))


_OWN = "(SELECT class, feature, coalesce(median(abs(shap)) FILTER (class = true_class), 0.0) AS importance FROM H GROUP BY 1, 2)"


@register("l2_true_class_median", f"SELECT * FROM {_OWN} o", "importance", "P H")
def l2(spark, sf):
    return L.true_class_median(shap_long(spark, sf))


@register("l2_h9_top_features_per_class", f"SELECT *, CAST(row_number() OVER (PARTITION BY class ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM {_OWN} o QUALIFY rank <= 8", "importance", "P H")
def l2b(spark, sf):
    return L.top_features_per_class(L.true_class_median(shap_long(spark, sf)))


for _rule, _sql in (("true_class_median", "median(abs(shap)) FILTER (class = true_class)"), ("median_all", "median(abs(shap))"), ("mean_all", "avg(abs(shap))")):
    register(f"l3_ranking_{_rule}", f"SELECT feature, {_sql} AS importance, CAST(row_number() OVER (ORDER BY {_sql} DESC, feature) AS INTEGER) AS rank FROM H GROUP BY 1", "importance", "P H")(
        lambda spark, sf, rule=_rule: L.shap_ranking(shap_long(spark, sf), rule))


@register("l4_shap_direction",
          """SELECT class, feature, d AS direction, CASE WHEN max(abs(d)) OVER () > 0 THEN d/max(abs(d)) OVER () ELSE d END AS direction_scaled FROM (
             SELECT class, feature, coalesce(avg(shap) FILTER (value >= b), 0.0) - coalesce(avg(shap) FILTER (value <= a), 0.0) AS d FROM (SELECT * FROM H WHERE class = true_class) h
             JOIN (SELECT class, feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM H WHERE class = true_class GROUP BY 1, 2) q USING (class, feature) GROUP BY 1, 2) t""",
          "direction direction_scaled", "P H")
def l4(spark, sf):
    return L.shap_direction(shap_long(spark, sf))
