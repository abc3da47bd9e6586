"""Composite plans over raw-looking tables derived from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import filters as W
from ..operators.impute import ForestParams, fit_imputer, impute
from ..operators.sampling import factorize, label_index, split_summary
from ..operators.score import baseline, model_vector
from ..operators.encode import collect_boundaries, fit_boundaries, missing_mask, quantile_encode
from ..operators.dedup import attach_mask
from ..plans import application as P
from ..plans import extraction as X
from ..plans import preparation as R
from ..session import scratch_folder, wide_plans
from ..sources.tables import write_table
from .agebins import binned
from .cleaning import _CITE, _CITE_SQL, _references
from . import agebins, uncertainty  # noqa: F401  their twins are used below
from .frames import CLASSES, ORACLE, SquareShares, hash_sql, register, samples, scored, shares_sql, table

ID = "sample_id"

# --- raw tables -------------------------------------------------------------------------------


def _stored(df, name):
    """A raw table as it would arrive: written once, then scanned."""
    wide_plans(df.sparkSession)
    return df.sparkSession.read.parquet(write_table(df, scratch_folder(df.sparkSession, name)))


_MAJOR = {
    "NA2O": "(20 + p % 15)*1e-1", "MGO": "(40 + (p*3) % 90)*1e-1", "AL2O3": "(125 + s % 70)*1e-1",
    "SIO2": "(440 + (p*7 + s) % 90)*1e-1", "P2O5": "(1 + s % 4)*1e-1", "K2O": "(2 + p % 9)*1e-1",
    "CAO": "(85 + (p + s) % 40)*1e-1", "TIO2": "(5 + s % 25)*1e-1", "MNO": "(10 + p % 11)*1e-2",
    "FEOT": "CASE WHEN p % 4 <> 0 THEN (70 + p % 50)*1e-1 END",
}
_TRACE = {
    t: f"CASE WHEN (p + {i}*s) % 5 <> 0 AND NOT (s % 7 = 0 AND {i} > 5) THEN (1 + (p*{i + 3} + s*{2 * i + 1}) % 400)*1e-1 END"
    for i, t in enumerate(K.TRACES)
}
_FEATURES = {**_MAJOR, **_TRACE}
_SETTINGS = [*K.SOURCE_A_LABELS, "UNKNOWN", "OTHER"]
_LABEL = "CASE p % 10 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_SETTINGS)) + " END"
_FERRIC = "CASE WHEN p % 4 = 0 AND s % 5 <> 0 THEN (80 + p % 50)*1e-1 END"
_LOI = "CASE WHEN s % 3 <> 0 THEN (p % 60)*1e-1 END"
_AGE = "CASE WHEN p % 9 = 0 THEN 'NEOARCHEAN [3]' WHEN p % 2 = 0 THEN 'CENOZOIC [12] [7]' END"
_CITES = _CITE.replace("l_suppkey", "s").replace("l_partkey", "p")
_BASE = "l_orderkey*10000000000 + l_partkey*100000 + l_suppkey*10 + l_linenumber AS sample_id, l_partkey AS p, l_suppkey AS s, l_linenumber AS ln"


def raw_a(spark, sf):
    """First source: long names, all text."""
    base = table(spark, sf, "lineitem").selectExpr(*_BASE.split(", "))
    text = lambda e: F.expr(f"CAST({e} AS STRING)")
    return _stored(base.select(
        ID, *[text(e).alias(K.SHORT_TO_LONG[c]) for c, e in _FEATURES.items()],
        text(_FERRIC).alias("FE2O3T(WT%)"), text(_LOI).alias("LOI(WT%)"),
        F.expr(f"CASE WHEN p % 13 <> 0 THEN {_CITES.format(s='STRING')} END").alias("CITATIONS"),
        F.expr("concat('about ', p, ' yrs')").alias("MIN. AGE (YRS.)"), F.expr("concat(p + s, ' (max)')").alias("MAX. AGE (YRS.)"),
        F.expr(_AGE).alias("AGE"), F.lit("FRESH").alias("ALTERATION"), F.expr(_LABEL).alias("TECTONIC SETTING"),
        *[text(f"(p % 360 - {o})*1e0").alias(n) for n, o in (("LONGITUDE MIN", 180), ("LONGITUDE MAX", 178))],
        *[text(f"(s % 180 - {o})*1e0").alias(n) for n, o in (("LATITUDE MIN", 90), ("LATITUDE MAX", 89))],
        F.expr("CASE WHEN p % 3 = 0 THEN concat('AFRICA / KAAPVAAL CRATON_ARCHEAN / SITE ', s) WHEN p % 3 = 1 THEN 'EUROPE / BALTIC SHIELD' END").alias("LOCATION"),
    ), "first")


def _closed_sql(c: str) -> str:
    return f"{c}/({'+'.join(K.MAJORS)})*100.0"


_R3 = "round_even({c}*1000.0, 0)/1000.0"
_RAW_SQL = (f"RAW AS (SELECT {_BASE} FROM lineitem), "
            "FE AS (SELECT sample_id, p, s, ln, " + ", ".join(f"{e} AS {c}" for c, e in _FEATURES.items() if c != "FEOT") +
            f", coalesce({_MAJOR['FEOT']}, {_FERRIC}*0.8998) AS FEOT, {_LOI} AS loi, {_AGE} AS age, {_LABEL} AS label, "
            f"CASE WHEN p % 13 <> 0 THEN {_CITES.format(s='VARCHAR')} END AS cit FROM RAW)")
_PRESENT = "(" + "+".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in K.SHORT_FEATURES) + ")"
_OUT36 = ", ".join(f'{c} AS "{K.SHORT_TO_LONG[c]}"' for c in K.SHORT_FEATURES)
_RECODE_A = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.SOURCE_A_RECODE.items()) + " ELSE label END"
_YEARS = _CITE_SQL.split("SELECT sample_id, coalesce")[0].replace("{y}", "nullif(yr, 'N/A')")
_P1_SQL = f"""SELECT * FROM (WITH {_RAW_SQL},
  KEEP AS (SELECT sample_id, {", ".join(_R3.format(c=c) + f" AS {c}" for c in K.SHORT_FEATURES)}, loi, age, label, cit, p, s FROM FE
    WHERE {_closed_sql('SIO2')} BETWEEN 45 AND 53 AND {_closed_sql('MGO')} BETWEEN 4.5 AND 12 AND {_closed_sql('AL2O3')} BETWEEN 12 AND 19
      AND (loi < 5 OR loi IS NULL) AND NOT coalesce(contains(age, 'ARCHEAN'), FALSE) AND {_PRESENT} >= 20),
  DED AS (SELECT min(sample_id) AS sample_id, {", ".join(K.SHORT_FEATURES)}, loi, age, label, cit, p, p + s AS mx, p % 360 - 179.0 AS longitude, s % 180 - 89.5 AS latitude FROM KEEP
    GROUP BY {", ".join(K.SHORT_FEATURES)}, loi, age, label, cit, p, p + s, p % 360, s % 180),
  CAP AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42)}, sample_id) AS r FROM DED WHERE label NOT IN ('UNKNOWN', 'OTHER')),
  {_YEARS}
  SELECT CAP.sample_id, {_OUT36}, {_RECODE_A} AS "TECTONIC SETTING", CAST(longitude AS DOUBLE) AS longitude, CAST(latitude AS DOUBLE) AS latitude,
    CASE WHEN age IS NULL THEN '' ELSE split_part(age, ' [', 1) END AS "AGE", coalesce(nullif(years, ''), 'N/A') AS "PUBLICATION_YEAR"
  FROM CAP LEFT JOIN Y ON CAP.cit = Y.cit WHERE r <= 20000) q"""


def _a(spark, sf):
    return X.extract_source_a(raw_a(spark, sf), _references(spark, sf), cap=20000)


_P1_SQL = _P1_SQL.replace(
    "C AS (SELECT sample_id, CASE WHEN l_partkey % 13 <> 0 THEN " + _CITE.format(s="VARCHAR") + " END AS cit FROM S)",
    "C AS (SELECT cit FROM CAP)")


@register("p1_extract_source_a", _P1_SQL, " ".join(K.LONG_FEATURES))
def p1(spark, sf):
    return _a(spark, sf)


def raw_b(spark, sf):
    """Second source: one analysis spread over rows, majors and traces apart, other names."""
    base = table(spark, sf, "lineitem").selectExpr(*_BASE.replace("l_suppkey AS s", "l_suppkey % 3 AS s").split(", "))
    major = [F.expr(f"CASE WHEN ln % 2 = 0 THEN CAST({_MAJOR[c]} AS STRING) END").alias(c.title().replace("Sio2", "SiO2") + " (wt%)") for c in K.MAJORS]
    trace = [F.expr(f"CASE WHEN ln % 2 = 1 THEN CAST({_trace_b(c)} AS STRING) END").alias("CO.1" if c == "CO" else c) for c in K.TRACES]
    return _stored(base.select(
        ID, F.expr("CASE WHEN p % 17 <> 0 THEN CAST(p AS STRING) END").alias("Sample Name"),
        F.expr("concat('SMITH, 199', s, '; DOE, 2001')").alias("Citation"),
        F.expr("CASE p % 6 WHEN 0 THEN 'OCEAN_ISLAND' WHEN 1 THEN 'BACK-ARC BASIN' WHEN 2 THEN 'SPREADING CENTER' WHEN 3 THEN 'OCEANIC_PLATEAU' WHEN 4 THEN 'ELSEWHERE' ELSE 'CONTINENTAL RIFT' END").alias("Tectonic Setting"),
        F.expr("CAST((p % 360 - 180)*1e0 AS STRING)").alias("Longitude"), F.expr("CAST((p % 180 - 90)*1e0 AS STRING)").alias("Latitude"),
        F.expr("CASE WHEN p % 11 = 0 THEN 'Archean' END").alias("Geologic Age"), F.lit("Late").alias("Geologic Age Prefix"), *major, *trace), "second")


def _trace_b(c: str) -> str:
    plain = _TRACE[c].replace(" AND NOT (s % 7 = 0", " AND NOT (s % 7 = 9")
    return f"CASE WHEN p % 5 = 0 THEN ln*1e0 ELSE {plain} END" if c == "V" else plain


_B_COLS = {**{c: f"CASE WHEN ln % 2 = 0 THEN {_MAJOR[c]} END" for c in K.MAJORS}, **{c: f"CASE WHEN ln % 2 = 1 THEN {_trace_b(c)} END" for c in K.TRACES}}
_B_RAW = ("RAWB AS (SELECT sample_id, p, s, ln, CASE WHEN p % 17 = 0 THEN sample_id END AS lone, " + ", ".join(f"{e} AS {c}" for c, e in _B_COLS.items()) +
          f" FROM (SELECT {_BASE.replace('l_suppkey AS s', 'l_suppkey % 3 AS s')} FROM lineitem) t)")
_P2_SQL = f"""SELECT * FROM (WITH {_B_RAW},
  GR AS (SELECT p, s, lone, min(sample_id) AS sample_id, min(V) < max(V) AS clash, {", ".join(f"min({c}) AS {c}" for c in K.SHORT_FEATURES)} FROM RAWB GROUP BY 1, 2, 3),
  ALLR AS (SELECT sample_id, p, s, {", ".join(K.SHORT_FEATURES)} FROM GR WHERE NOT coalesce(clash, FALSE)
    UNION ALL SELECT r.sample_id, r.p, r.s, {", ".join("r." + c for c in K.SHORT_FEATURES)} FROM RAWB r JOIN GR g ON r.p = g.p AND r.s = g.s AND r.lone IS NOT DISTINCT FROM g.lone WHERE g.clash),
  KEEP AS (SELECT * FROM ALLR WHERE p % 11 <> 0 AND {_PRESENT} >= 20 AND {_closed_sql('SIO2')} BETWEEN 45 AND 53 AND {_closed_sql('MGO')} BETWEEN 4.5 AND 12 AND {_closed_sql('AL2O3')} BETWEEN 12 AND 19),
  LAB AS (SELECT *, CASE p % 6 WHEN 0 THEN 'OCEAN ISLAND' WHEN 1 THEN 'BACK-ARC_BASIN' WHEN 2 THEN 'SPREADING_CENTER' WHEN 3 THEN 'OCEANIC PLATEAU' WHEN 5 THEN 'CONTINENTAL_RIFT' END AS label FROM KEEP),
  CAP AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42)}, sample_id) AS r FROM LAB WHERE label IS NOT NULL)
  SELECT sample_id, {", ".join(f'{_R3.format(c=c)} AS "{K.SHORT_TO_LONG[c]}"' for c in K.SHORT_FEATURES)}, label AS "TECTONIC SETTING", CAST(p % 360 - 180 AS DOUBLE) AS longitude, CAST(p % 180 - 90 AS DOUBLE) AS latitude,
    CAST(NULL AS VARCHAR) AS "AGE", concat('199', CAST(s AS VARCHAR), '; 2001') AS "PUBLICATION_YEAR" FROM CAP WHERE r <= 20000) q"""


def _b(spark, sf):
    return X.extract_source_b(raw_b(spark, sf), cap=20000)


@register("p2_extract_source_b", _P2_SQL, " ".join(K.LONG_FEATURES))
def p2(spark, sf):
    return _b(spark, sf)[0]


@register("p2_consolidation_counts",
          f"SELECT * FROM (WITH {_B_RAW}, GR AS (SELECT p, s, lone, count(*) AS n, coalesce(min(V) < max(V), FALSE) AS clash FROM RAWB GROUP BY 1, 2, 3) SELECT count(*) FILTER (NOT clash) AS safe_groups, count(*) FILTER (clash) AS conflict_groups, CAST(coalesce(sum(n) FILTER (clash), 0) AS BIGINT) AS conflict_rows FROM GR) q")
def p2b(spark, sf):
    return _b(spark, sf)[1]


_P3_SQL = f"""SELECT split, "TECTONIC SETTING", CASE split WHEN 'test' THEN t ELSE c - t END AS count,
  round(CASE split WHEN 'test' THEN t ELSE c - t END*100.0/sum(CASE split WHEN 'test' THEN t ELSE c - t END) OVER (PARTITION BY split), 4) AS percent FROM (
    SELECT "TECTONIC SETTING", c, CAST(base + CASE WHEN row_number() OVER (ORDER BY want - base DESC, "TECTONIC SETTING") <= goal - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS t FROM (
      SELECT "TECTONIC SETTING", c, goal, c*goal/n AS want, floor(c*goal/n) AS base FROM (
        SELECT "TECTONIC SETTING", count(*) AS c, sum(count(*)) OVER () AS n, ceil(sum(count(*)) OVER () * 0.2) AS goal FROM (
          SELECT "TECTONIC SETTING" FROM ({_P1_SQL}) a UNION ALL SELECT "TECTONIC SETTING" FROM ({_P2_SQL}) b) u GROUP BY 1) x) y) z, (VALUES ('train'), ('test')) AS v(split)"""


@register("p3_merge_and_split", _P3_SQL, "percent")
def p3(spark, sf):
    both = X.merge_and_split([_a(spark, sf), _b(spark, sf)[0].withColumn(ID, -F.col(ID))])
    return split_summary(both, "TECTONIC SETTING")


# --- preparation and cross-validation ---------------------------------------------------------

COLS = ["m1", "m2", "m3", "m4"]
SMALL = ForestParams(trees=3, max_depth=4, parallel_fits=4)


def _prepared(spark, sf):
    s = samples(spark, sf).select(ID, "label", "source", *COLS)
    train, test = s.where("source = 'F'"), s.where("source = 'O'")
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    return R.prepare(train.drop("source"), test.drop("source"), COLS, ["m1", "m2"], "label", {"A": counts["A"] + 300}, SMALL)


@register("p4_prepare",
          "SELECT label, is_synthetic, CASE WHEN is_synthetic THEN 300 ELSE n END AS n, TRUE AS in_range, CASE WHEN is_synthetic THEN 0 ELSE m3 END AS masked_m3 FROM "
          "(SELECT label, count(*) AS n, count(*) FILTER (m3 IS NULL) AS m3 FROM S WHERE source = 'F' GROUP BY 1) t, (VALUES (TRUE), (FALSE)) AS v(is_synthetic) WHERE NOT is_synthetic OR label = 'A'", views="S")
def p4(spark, sf):
    rows = _prepared(spark, sf).train
    return rows.groupBy("label", "is_synthetic").agg(
        F.count(F.lit(1)).alias("n"), (F.min(F.least(*COLS)) >= 1).alias("in_range"),
        F.sum("missing_mask__m3").alias("masked_m3"))


@register("p11_j22_cross_validation")
def p11(spark, sf):
    e = scored(spark, sf).select(ID, F.col("pred_class_name").alias("label"), F.col("BA").alias("m1"), F.expr("nullif(TH, 0)").alias("m2"), "LA", "NB")
    runs, _ = R.cross_validate(
        e, ["m1", "m2", "LA", "NB"], ["m1", "m2"], "label", {"view": 2100}, {"random_forest": {"numTrees": 3, "maxDepth": 3}}, seeds=(42, 123), k=5, params=SMALL)
    return runs


# --- application ------------------------------------------------------------------------------


def _short(spark, sf, extra=()):
    base = table(spark, sf, "lineitem").selectExpr(*_BASE.split(", "))
    full = {**_FEATURES, "FEOT": f"coalesce({_MAJOR['FEOT']}, (90 + p % 30)*1e-1)"}
    cells = [F.expr(f"CAST({e} AS STRING)").alias(c) for c, e in full.items()]
    return _stored(base.select(ID, *[F.expr(e).alias(n) for n, e in extra], *cells), "application")


_META = [("Craton", "CASE WHEN s % 3 = 0 THEN 'North' ELSE 'South' END"), ("REFERENCE", "concat('Report ', s % 4)"), ("AGE", "2500.0 + (p % 100)*10")]
_SHORT_SQL = (f"SH AS (SELECT sample_id, p, s, " + ", ".join(f"{e} AS {c}" for c, e in {**_FEATURES, "FEOT": f"coalesce({_MAJOR['FEOT']}, (90 + p % 30)*1e-1)"}.items()) + f" FROM (SELECT {_BASE} FROM lineitem) t)")
_GATE_SQL = (f"GA AS (SELECT sample_id, p, s, " + ", ".join(f"{_closed_sql(c)} AS {c}" for c in K.MAJORS) + ", " + ", ".join(K.TRACES) +
             f", CAST(36 - {_PRESENT} AS INTEGER) AS missing_feature_count_36 FROM SH WHERE 36 - {_PRESENT} < 18 AND {_closed_sql('SIO2')} BETWEEN 44 AND {{hi}} AND {_closed_sql('MGO')} <= 18)")


@register("p6_gate", f"SELECT * FROM (WITH {_SHORT_SQL}, {_GATE_SQL.format(hi=53)} SELECT sample_id, {', '.join(K.SHORT_FEATURES)}, missing_feature_count_36 FROM GA) q", " ".join(K.MAJORS))
def p6(spark, sf):
    return P.gate(_short(spark, sf), [ID])


@register("p6_gate_cases",
          f"""SELECT * FROM (WITH {_SHORT_SQL}, {_GATE_SQL.format(hi=53)} SELECT 'north' AS case_label, count(*) AS n, avg(SIO2) AS mean_sio2 FROM GA WHERE s % 3 = 0 AND 2500 + (p % 100)*10 BETWEEN 3000 AND 3100
              UNION ALL SELECT 'south', count(*), avg(SIO2) FROM GA WHERE s % 3 <> 0 AND s % 4 = 2) q""", "mean_sio2")
def p6b(spark, sf):
    areas = [W.CaseArea("north", "North", 3.05, "North", 3000.0, 3100.0), W.CaseArea("south", "South", 2.7, "South", keyword="REPORT 2")]
    rows = P.gate_cases(_short(spark, sf, _META), areas, [ID, "Craton", "REFERENCE", "AGE"])
    return rows.groupBy("case_label").agg(F.count(F.lit(1)).alias("n"), F.avg("SIO2").alias("mean_sio2"))


def _pool(spark, sf):
    second = raw_a(spark, sf).where(F.expr(f"{ID} % 3 = 0"))
    return P.expanded_pool(_short(spark, sf).where(F.expr(f"{ID} % 3 <> 0")), second)


_KEY36 = "concat_ws('|', " + ", ".join(
    f"CAST(coalesce(round_even(({_closed_sql(c) if c in K.MAJORS else c})*1000.0, 0)/1000.0, -999999.0) AS VARCHAR)" for c in K.SHORT_FEATURES) + ")"
_GATED = f"36 - {_PRESENT} < 18 AND {_closed_sql('SIO2')} BETWEEN 44 AND 54 AND {_closed_sql('MGO')} <= 18"
_P5_SQL = f"""SELECT * FROM (WITH {_RAW_SQL}, {_SHORT_SQL},
  A AS (SELECT {_KEY36} AS k FROM SH WHERE sample_id % 3 <> 0 AND {_GATED}),
  D AS (SELECT {_KEY36} AS k FROM FE WHERE sample_id % 3 = 0 AND contains(age, 'ARCHEAN') AND {_GATED}),
  U AS (SELECT k FROM A UNION ALL SELECT k FROM D)
  SELECT (SELECT count(*) - count(DISTINCT k) FROM U) AS removed, (SELECT count(DISTINCT k) FROM U) AS pool_rows, (SELECT count(*) - count(DISTINCT k) FROM A) AS first_internal,
    (SELECT count(*) - count(DISTINCT k) FROM D) AS second_internal, (SELECT count(*) FROM D WHERE k IN (SELECT k FROM A)) AS cross_source) q"""


@register("p5_expanded_pool_counts", _P5_SQL)
def p5(spark, sf):
    return _pool(spark, sf)[1]


def _trained(spark, sf):
    """Reference rows (F), their imputer, boundaries and a small classifier over three labels."""
    ref = samples(spark, sf).where("source = 'F'").select(ID, "label", *COLS)
    imputer = fit_imputer(ref, COLS, SMALL)
    full = P.cut_lineage(P.anhydrous(impute(ref, imputer), ["m1", "m2"], "domain"))
    bounds = collect_boundaries(fit_boundaries(full, COLS))
    index = label_index(full, "label", ID)
    coded = attach_mask(quantile_encode(full, bounds), missing_mask(ref, COLS, keep=[ID]), ID)
    rows = model_vector(factorize(coded, "label", ID, index, "_y"), COLS)
    rows = P.cut_lineage(rows.select("features", F.col("_y").cast("double").alias("label")))
    models = [baseline("random_forest", seed, 8, 3, numTrees=3, maxDepth=4).fit(rows) for seed in (1, 2)]
    names = [r[0] for r in index.orderBy("index").collect()]
    return ref, full, imputer, bounds, models, names


@register("p5_pool_report")
def p5b(spark, sf):
    ref, full, imputer, bounds, models, names = _trained(spark, sf)
    pool = samples(spark, sf).where("source = 'O'").withColumn("POOL_COMPONENT", F.concat(F.lit("part "), (F.col("l_suppkey") % 2).cast("string")))
    return P.pool_report(pool, full, COLS, ["m1", "m2"], imputer, bounds, models, names, ["A"])


@register("p7_score_application")
def p7(spark, sf):
    _, _, _, bounds, models, names = _trained(spark, sf)
    rows = samples(spark, sf).where("source = 'O'").withColumn("AGE", 2500.0 + F.col("l_partkey") % 150 * 10.0)
    out = P.score_application(rows, COLS, ["m1", "m2"], bounds, models, names, ["A"], high_p=0.35)
    return P.G.summarize_by_age(out, names)


_STEPS = {"m1": 0.4, "m2": 0.4, "m3": 0.05, "m4": 0.05}  # widths of the code cells
_CLOSED = {"m1": "m1/t*100.0", "m2": "m2/t*100.0", "m3": "m3", "m4": "m4"}
_CODED = [f"CASE WHEN c{i} IS NULL THEN 0 ELSE 1 + len(list_filter(range(1, 255), lambda b: b*CAST({_STEPS[c]} AS DOUBLE) < c{i})) END/255.0" for i, c in enumerate(COLS)] + \
    [f"CAST(c{i} IS NULL AS INTEGER)" for i in range(len(COLS))]
_P7_PARTS = ["prob_A", "prob_N", "prob_R", "prob_std_A", "prob_std_N", "prob_std_R", "pred_prob_max", "pred_prob_std", "Arc_probability3"]
_P7_SQL = f"""SELECT sample_id, m1, m2, m3, m4, missing_feature_count_36, pred_class_name, top AS pred_prob_max, spread AS pred_prob_std,
    CASE WHEN top >= 0.4 AND spread <= 0.05 THEN 'high' WHEN top >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_tier,
    p0 AS "prob_A", p1 AS "prob_N", p2 AS "prob_R", s0 AS "prob_std_A", s1 AS "prob_std_N", s2 AS "prob_std_R", p0 AS "Arc_probability3", p0 >= 0.5 AS liu_arc_binary,
    floor((2500.0 + l_partkey % 150 * 10.0)/200.0)*200.0 + 100.0 AS age_bin_mid_ma
  FROM (SELECT *, greatest(p0, p1, p2) AS top, CASE greatest(p0, p1, p2) WHEN p0 THEN 'A' WHEN p1 THEN 'N' ELSE 'R' END AS pred_class_name,
          CASE greatest(p0, p1, p2) WHEN p0 THEN s0 WHEN p1 THEN s1 ELSE s2 END AS spread
        FROM ({shares_sql([f"x{i}" for i in range(8)], 3, (1, 2)).format(source="CODED")}) a) b"""


@register("p7_score_values",
          f"""SELECT * FROM (WITH CLOSED AS (SELECT *, {', '.join(f'{e} AS c{i}' for i, e in enumerate(_CLOSED.values()))} FROM
                (SELECT *, nullif(coalesce(m1, 0) + coalesce(m2, 0), 0) AS t, CAST((m1 IS NULL)::INTEGER + (m2 IS NULL)::INTEGER + (m3 IS NULL)::INTEGER + (m4 IS NULL)::INTEGER AS INTEGER) AS missing_feature_count_36
                 FROM S WHERE source = 'O') r WHERE missing_feature_count_36 < 4),
              CODED AS (SELECT *, {', '.join(f'{e} AS x{i}' for i, e in enumerate(_CODED))} FROM CLOSED) {_P7_SQL}) q""", " ".join(_P7_PARTS), "S")
def p7b(spark, sf):
    """The scoring plan row by row, with fixed code cells and two classifiers whose shares SQL can state."""
    rows = samples(spark, sf).where("source = 'O'").withColumn("AGE", 2500.0 + F.col("l_partkey") % 150 * 10.0)
    bounds = {c: [i * step for i in range(1, 255)] for c, step in _STEPS.items()}
    models = [SquareShares((0.0, 1.0, 2.0), 2 * len(COLS), turn) for turn in (1, 2)]
    out = P.score_application(rows, COLS, ["m1", "m2"], bounds, models, ["A", "N", "R"], ["A"], high_p=0.4)
    return out.select(ID, *COLS, "missing_feature_count_36", "pred_class_name", "confidence_tier", "liu_arc_binary", "age_bin_mid_ma", *_P7_PARTS)


def _drift(spark, sf):
    ref, full, imputer, bounds, models, names = _trained(spark, sf)
    app = samples(spark, sf).where("source = 'O'").withColumn("unit", F.col("l_suppkey") % 20)
    filled = P.cut_lineage(impute(app, imputer))
    return P.drift_report(ref, full, app, filled, COLS, ["m1", "m2"], bounds, models, names, ["A"], "label", "N", "unit")


for _part in ("class", "source"):
    register(f"p8_drift_report_{_part}")(lambda spark, sf, part=_part: _drift(spark, sf)[part])


def _coverage(spark, sf):
    s = samples(spark, sf).withColumn("arc", F.col("m1") / 50)
    return P.domain_coverage(s.where("source = 'F'"), s.where("source = 'O'"), COLS, "label", "arc", "R", 1000)


for _part in ("coverage", "ellipses"):
    register(f"p9_domain_{_part}")(lambda spark, sf, part=_part: _coverage(spark, sf)[part])


def _evidence(spark, sf):
    e = binned(spark, sf).drop("age_bin", "age_bin_mid_ma", "age_bin_label")
    bad = (F.col("sample_id") == 77) & (F.col("BA") > 0)
    return P.age_evidence(e, CLASSES, {"Ba_La": ("BA", "LA"), "Th_Nb": ("TH", "NB")}, ID, bad_record=bad, threshold=0.1, reps=100)


@register("p10_age_evidence_shares",
          "SELECT mid/1000.0 AS age_mid_ga, CAST(0.1 AS DOUBLE) AS threshold, count(*) FILTER (\"Arc_probability3\" >= 0.1) AS n_high, count(*) FILTER (\"Arc_probability3\" >= 0.1)/count(*) AS ratio_arc FROM B WHERE NOT (sample_id = 77 AND \"BA\" > 0) GROUP BY mid",
          "age_mid_ga ratio_arc", "E B")
def p10(spark, sf):
    return _evidence(spark, sf)["shares"]


def _twin(name, *swaps):
    """The twin of a table's own operator, over the rows that the composite keeps."""
    text = ORACLE[name]
    for old, new in (("FROM events)", "FROM events WHERE event_id <> 77)"), *swaps):
        if old not in text:
            raise ValueError(f"{name}: no {old}")
        text = text.replace(old, new)
    return text


_SUMMARY_DOUBLES = (
    "age_mid_ga ratio_9class_arc_all mean_arc_probability ratio_arc_probability_ge_0_5 ratio_9class_arc_high ratio_liu_arc mean_pred_prob "
    + " ".join(f"ratio_{c}" for c in CLASSES))
for _part, _sql, _doubles in (
    ("summary", _twin("g10_summarize_by_age"), _SUMMARY_DOUBLES), ("proportions", _twin("m2_proportion_ci"), "age_mid_ga frac lo hi"),
    ("histogram", _twin("g28_age_histogram", ('"Arc_probability3" >= 0.5', '"Arc_probability3" >= 0.1')), "age_mid_ga"),
    ("sensitivity", _twin("g27_fixed_bins", ('nullif("TH",0)', 'nullif("LA",0)')), "age_mid_ga mean_arc median_ratio"),
    ("sliding", _twin("g26_e7_sliding_mean"), "age_mid_ga mean_arc"),
):
    register(f"p10_age_evidence_{_part}", _sql, _doubles)(lambda spark, sf, part=_part: _evidence(spark, sf)[part])

register("p10_age_evidence_ratios")(lambda spark, sf: _evidence(spark, sf)["ratios"])
