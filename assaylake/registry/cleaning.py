"""Sources, schema alignment, scalar functions, filters, lookups, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .. import constants as K
from ..functions import numeric as N
from ..functions import text as T
from ..operators import composition as C
from ..operators import dedup as D
from ..operators import encode as X
from ..operators import filters as W
from ..operators import sampling as Z
from ..operators import schema as B
from ..operators import summaries as G
from ..session import scratch_folder
from ..sources import tables as A
from .frames import ARC, register, samples, scored, table

M = ["m1", "m2", "m3", "m4"]
FULL = "(m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL AND m4 IS NOT NULL)"
SUM = "(m1+m2+m3+m4)"
SEEN = "(coalesce(m1,0)+coalesce(m2,0)+coalesce(m3,0)+coalesce(m4,0))"


def _closed(total: str, parts: str = "{c}") -> str:
    return ", ".join(f"{parts.format(c=c)}/{total}*100.0 AS {c}" for c in M)


# --- the first query end to end ---------------------------------------------------------------


@register(
    "flagship_age_shares",
    f"""SELECT floor(l_partkey/200.0)*200.0 + 100.0 AS age_mid, count(*) AS n_all,
      CAST(sum(CASE WHEN hi THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
      sum(CASE WHEN hi THEN 1 ELSE 0 END)/count(*) AS ratio_high, avg(c1) AS mean_m1
    FROM (SELECT min(sample_id) AS sample_id, l_partkey, c1, c2, c1 >= 25 AS hi FROM (
        SELECT sample_id, l_partkey, round_even(m1/{SUM}*100000.0, 0)/1000.0 AS c1,
               round_even(m2/{SUM}*100000.0, 0)/1000.0 AS c2
        FROM S WHERE {FULL} AND m1/{SUM}*100.0 BETWEEN 10 AND 60) t
      GROUP BY l_partkey, c1, c2) d GROUP BY 1""",
    "ratio_high mean_m1", "S",
)
def flagship(spark, sf):
    """Scan, closure, completeness and range gate, exact dedup, flag, age bin, summary."""
    s = W.require(samples(spark, sf), M)
    s = s.where(C.closed_in_bounds(M, {"m1": (10.0, 60.0)}))
    s = C.anhydrous(s, M, "strict")
    s = s.select("sample_id", "l_partkey", N.round_half_even("m1").alias("c1"),
                 N.round_half_even("m2").alias("c2"))
    s = D.dedup_exact(s, "sample_id")
    s = s.withColumn("age_bin", G.age_bin(F.col("l_partkey").cast("double"), 200.0))
    return s.groupBy(F.col("age_bin.mid").alias("age_mid")).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("c1") >= 25).alias("n_high"),
        G.share(F.col("c1") >= 25).alias("ratio_high"), F.avg("c1").alias("mean_m1"))


# --- A: sources and sinks ---------------------------------------------------------------------


@register("a1_a2_a3_csv_fallback", "SELECT p_brand, count(*) AS n, sum(p_retailprice) AS total FROM part GROUP BY 1", "total")
def csv_fallback(spark, sf):
    path = scratch_folder(spark, "csv")
    part = table(spark, sf, "part").withColumn("note", F.lit("é")).repartition(4)
    A.write_table(part, path, "csv", encoding="ISO-8859-1")
    back = A.read_csv_fallback(spark, path, ("UTF-8", "ISO-8859-1"))
    return back.groupBy("p_brand").agg(
        F.count_if(F.col("note") == "é").alias("n"), F.sum(N.to_number("p_retailprice")).alias("total"))


@register("a1_a2_mixed_encodings",
          "SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN 'é' ELSE 'é' || chr(65533) END AS note, p_name || chr(10) || '\"' || p_brand AS name FROM part")
def mixed_encodings(spark, sf):
    """Half of the rows with a byte-order mark and a genuine U+FFFD, half in ISO-8859-1, line breaks and quotes in cells."""
    path = scratch_folder(spark, "mixed")
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part"), F.lit("é").alias("note"), F.concat("p_name", F.lit('\n"'), "p_brand").alias("name")).repartition(4)
    A.write_table(part.where("part % 2 = 0"), f"{path}/old", "csv", encoding="ISO-8859-1")
    A.write_table(part.where("part % 2 <> 0").withColumn("note", F.lit("é\ufffd")), f"{path}/new", "csv", encoding="utf-8-sig")
    back = A.read_csv_fallback(spark, [f"{path}/old", f"{path}/new"])
    return back.select(F.col("part").cast("bigint").alias("part"), "note", "name")


@register("a4_params_roundtrip",
          """SELECT 'm2' AS feature, r AS rank, v AS boundary FROM (
             SELECT m2 AS v, row_number() OVER (ORDER BY m2) - 1 AS pos, count(*) OVER () AS n FROM S) t
             JOIN range(1, 20) AS g(r) ON pos = least(CAST(round_even(n*r/20.0, 0) AS BIGINT), n-1)""", "boundary", "S")
def params_roundtrip(spark, sf):
    path = scratch_folder(spark, "params")
    A.save_params(X.fit_boundaries(samples(spark, sf), ["m2"], 20), path)
    long = A.load_params(spark, path).select("feature", F.posexplode("boundaries").alias("i", "boundary"))
    return long.select("feature", (F.col("i") + 1).cast("bigint").alias("rank"), "boundary")


@register("a5_write_mask", "SELECT sample_id, CAST(m3 IS NULL AS TINYINT) AS missing_mask__m3, CAST(m4 IS NULL AS TINYINT) AS missing_mask__m4 FROM S", views="S")
def write_mask(spark, sf):
    path = scratch_folder(spark, "mask")
    A.write_mask(X.missing_mask(samples(spark, sf), ["m3", "m4"], keep=["sample_id"]), path)
    return spark.read.parquet(path)


@register("a6_resume_or", "SELECT c_custkey, c_name FROM customer")
def resume(spark, sf):
    fresh = table(spark, sf, "customer").select("c_custkey", "c_name")
    return A.resume_or(table(spark, sf, "nation"), fresh, ["c_name_AI"])


# --- B: schema --------------------------------------------------------------------------------


@register("b1_b2_standard_columns",
          "SELECT s_suppkey AS \"SAMPLE ID\", s_acctbal AS \"BALANCE(USD)\", CAST(NULL AS VARCHAR) AS \"AGE\" FROM supplier",
          "BALANCE(USD)")
def standard_columns(spark, sf):
    raw = table(spark, sf, "supplier")
    out = B.add_standard_columns(
        raw, ["SAMPLE ID", "BALANCE(USD)"],
        {"SAMPLE ID": ["nope", "S SUPP KEY"], "BALANCE(USD)": ["SACCTBAL"]}, optional=["AGE"])
    if "AGE" not in out.columns:
        out = out.withColumn("AGE", F.lit(None).cast("string"))
    return out.select("SAMPLE ID", "BALANCE(USD)", "AGE")


@register("b3_normalize_names", "SELECT r_regionkey AS RREGIONKEY, r_name AS RNAME FROM region")
def normal_names(spark, sf):
    return B.normalize_names(table(spark, sf, "region").toDF("r_region key(id)", "r.name (text)"))


def _wide(spark, sf, names=K.SHORT_FEATURES):
    """36 text columns out of the order lines; unreadable and missing cells included."""
    s = samples(spark, sf)
    cells = {}
    for i, name in enumerate(names):
        value = F.expr(f"cast(({_WIDE.format(i=i)}) as string)")
        cells[name] = F.when(F.col("sample_id") % (11 + i) == 0, F.lit("n.d.")).otherwise(value)
    return s.select("sample_id", "label", *[c.alias(n) for n, c in cells.items()])


_WIDE = "m2 + (l_partkey % ({i} + 7)) + {i}"


@register("b4_b5_b6_extract_features",
          "SELECT sample_id, " + ", ".join(
              f'CASE WHEN sample_id % {11 + i} <> 0 THEN {_WIDE.format(i=i)} END AS "{K.SHORT_TO_LONG[n]}"'
              for i, n in enumerate(K.SHORT_FEATURES)) + " FROM S",
          views="S")
def features(spark, sf):
    return B.short_to_long(B.extract_features(_wide(spark, sf), ["sample_id"]))


@register("b7_restore_original", "SELECT sample_id, upper(label) AS label, m1, m2, m3, m4, source, l_orderkey, l_partkey, l_suppkey FROM S WHERE m1 > 40", views="S")
def restore(spark, sf):
    s = samples(spark, sf)
    kept = s.where("m1 > 40").select("sample_id", F.upper("label").alias("label"))
    return B.restore_original(kept, s, "sample_id", ["label"])


@register("b8_b9_conform", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS depth FROM customer")
def conform(spark, sf):
    want = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("depth", DoubleType())])
    raw = table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name"})
    return B.columns_last(B.conform(raw, want), ["id"])


@register("b10_feature_faults",
          "SELECT count(*) FILTER (m1 IS NULL) AS m1, count(*) FILTER (m2 IS NULL) AS m2, "
          "count(*) FILTER (m3 IS NULL) AS m3, count(*) FILTER (m4 IS NULL) AS m4 FROM S", views="S")
def faults(spark, sf):
    B.validate_features(samples(spark, sf), ["m1", "m2"])
    return B.feature_faults(samples(spark, sf), M)


@register("b11_label_problems", "SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1 HAVING count(*) < 80")
def labels(spark, sf):
    return B.label_problems(table(spark, sf, "part"), "p_brand", 80)


@register("b12_expect_rows", "SELECT n_nationkey, n_name FROM nation")
def rows(spark, sf):
    return B.expect_rows(table(spark, sf, "nation"), 25).select("n_nationkey", "n_name")


# --- C: scalar functions ----------------------------------------------------------------------

_IRON_SQL = """
  CASE WHEN f1 IS NOT NULL THEN f1 WHEN f2 IS NOT NULL THEN f2*0.8998
       WHEN f3 IS NOT NULL AND f4 IS NOT NULL THEN f3 + f4*0.8998 WHEN f3 IS NOT NULL THEN f3
       WHEN f4 IS NOT NULL THEN f4*0.8998 WHEN f5 IS NOT NULL THEN f5 END"""
_IRON_NAME = """
  CASE WHEN f1 IS NOT NULL THEN 'FeOT' WHEN f2 IS NOT NULL THEN 'Fe2O3T'
       WHEN f3 IS NOT NULL AND f4 IS NOT NULL THEN 'FeO+Fe2O3' WHEN f3 IS NOT NULL THEN 'FeO'
       WHEN f4 IS NOT NULL THEN 'Fe2O3' WHEN f5 IS NOT NULL THEN 'Fe' END"""
_IRON = {
    "FeOT": "CASE WHEN l_partkey % 5 = 0 THEN m1 END", "Fe2O3T (wt%)": "CASE WHEN l_partkey % 7 = 0 THEN m2 END",
    "FEO": "m3", "FE2O3": "m4", "Fe": "CASE WHEN l_suppkey % 2 = 0 THEN m1 END",
}
_IRON_FROM = "(SELECT sample_id, " + ", ".join(f"{e} AS f{i + 1}" for i, e in enumerate(_IRON.values())) + " FROM S) i"


def _iron(spark, sf):
    s = samples(spark, sf)
    return C.calculate_feot(
        s.select("sample_id", *[F.expr(e).cast("string").alias(c) for c, e in _IRON.items()]), True)


@register("c1_iron_fill", f'SELECT sample_id, {_IRON_SQL} AS "FEOT(WT%)", {_IRON_NAME} AS feot_source FROM {_IRON_FROM}', "FEOT(WT%)", "S", digits=10)
def iron(spark, sf):
    return _iron(spark, sf).select("sample_id", "FEOT(WT%)", "feot_source")


@register("g2b_g3_iron_source_counts", f"SELECT feot_source, count(*) AS n FROM (SELECT {_IRON_NAME} AS feot_source FROM {_IRON_FROM}) t GROUP BY 1", views="S")
def iron_counts(spark, sf):
    return C.feot_source_counts(_iron(spark, sf))


@register("c2_closure_strict", f"SELECT sample_id, {_closed(SUM)}, {FULL} AS valid FROM S", "m1 m2 m3 m4", "S")
def closure_strict(spark, sf):
    return C.anhydrous(samples(spark, sf), M, "strict").select("sample_id", *M, "valid")


@register("c3_closure_raise", "SELECT sample_id, m1/(m1+m2)*100.0 AS m1, m2/(m1+m2)*100.0 AS m2 FROM S", "m1 m2", "S")
def closure_raise(spark, sf):
    return C.anhydrous(samples(spark, sf), ["m1", "m2"], "raise").select("sample_id", "m1", "m2")


_POS = "(coalesce(m1,0)+coalesce(m2,0)+coalesce(m3,0)+greatest(coalesce(m4-3,0),0))"


@register("c4_closure_positive",
          f"SELECT sample_id, m1/{_POS}*100.0 AS m1, m2/{_POS}*100.0 AS m2, m3/{_POS}*100.0 AS m3, "
          f"CASE WHEN m4-3 > 0 THEN m4-3 END/{_POS}*100.0 AS m4 FROM S", "m1 m2 m3 m4", "S")
def closure_positive(spark, sf):
    s = samples(spark, sf).withColumn("m4", F.col("m4") - 3)
    return C.anhydrous(s, M, "positive", must_have_total=True).select("sample_id", *M)


@register("c5_closure_skipna", f"SELECT sample_id, {_closed('nullif(' + SEEN + ',0)')} FROM S", "m1 m2 m3 m4", "S")
def closure_skipna(spark, sf):
    return C.anhydrous(samples(spark, sf), M, "skipna").select("sample_id", *M)


@register("c6_closure_observed",
          "SELECT sample_id, m3/(coalesce(m3,0)+coalesce(m4,0))*100.0 AS m3, m4/(coalesce(m3,0)+coalesce(m4,0))*100.0 AS m4 FROM S",
          "m3 m4", "S")
def closure_observed(spark, sf):
    return C.anhydrous(samples(spark, sf), ["m3", "m4"], "observed").select("sample_id", "m3", "m4")


_AGE_TEXT = "concat(CASE WHEN doc_id % 3 = 0 THEN 'Neoarchean' WHEN doc_id % 3 = 1 THEN 'PROTEROZOIC' ELSE lang END, ' [', CAST(doc_id % 50 AS {s}), '] [7]')"


@register("c7_c8_c9_age_text",
          f"""SELECT doc_id, trim(regexp_replace(coalesce(age,''), '\\s*\\[\\d+\\]', '', 'g')) AS age_clean,
             CAST(nullif(regexp_extract(age, '(\\d+)', 1), '') AS DOUBLE) AS first_number,
             contains(upper(concat(coalesce(source,''), ' ', coalesce(age,''))), 'ARCHEAN') AS is_archean
             FROM (SELECT doc_id, source, CASE WHEN doc_id % 11 <> 0 THEN {_AGE_TEXT.format(s='VARCHAR')} END AS age FROM documents) d""")
def age_text(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "source", F.expr(f"CASE WHEN doc_id % 11 <> 0 THEN {_AGE_TEXT.format(s='STRING')} END").alias("age"))
    return d.select("doc_id", T.clean_age("age").alias("age_clean"), T.first_int("age").alias("first_number"),
                    T.is_archean("age", "source").alias("is_archean"))


@register("c10_c11_midpoint_round",
          "SELECT sample_id, (m1+m2)/2 AS middle, m1+(m2-m1)/2 AS middle2, round_even((m1+m2)/2*1000.0, 0)/1000.0 AS rounded FROM S",
          "middle middle2 rounded", "S")
def midpoints(spark, sf):
    mid = N.midpoint("m1", "m2")
    return samples(spark, sf).select("sample_id", mid.alias("middle"), N.midpoint("m1", "m2", "offset").alias("middle2"),
                                     N.round_half_even(mid).alias("rounded"))


_CITE = "concat('[', CAST(l_suppkey % 60 AS {s}), '][', CAST(l_partkey % 60 AS {s}), '][', CAST(l_suppkey % 60 AS {s}), ']')"
_REF_YEAR = "CASE WHEN item_id % 9 = 0 THEN 'N/A' ELSE CAST(1950 + (item_id * 7) % 70 AS {s}) END"


def _citations(spark, sf):
    return samples(spark, sf).select(
        "sample_id", F.expr(f"CASE WHEN l_partkey % 13 <> 0 THEN {_CITE.format(s='STRING')} END").alias("CITATIONS"))


def _references(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("reference_number"), F.expr(_REF_YEAR.format(s="STRING")).alias("year"))


_CITE_SQL = f"""
  C AS (SELECT sample_id, CASE WHEN l_partkey % 13 <> 0 THEN {_CITE.format(s='VARCHAR')} END AS cit FROM S),
  N AS (SELECT DISTINCT cit, CAST(unnest(regexp_extract_all(cit, '\\[(\\d+)\\]', 1)) AS BIGINT) AS num FROM C WHERE cit IS NOT NULL),
  R AS (SELECT item_id, {_REF_YEAR.format(s='VARCHAR')} AS yr FROM benchmark),
  Y AS (SELECT cit, string_agg(DISTINCT {{y}}, '; ' ORDER BY {{y}}) AS years FROM N LEFT JOIN R ON num = item_id GROUP BY cit)
  SELECT sample_id, coalesce(nullif(years, ''), 'N/A') AS "PUBLICATION_YEAR" FROM C LEFT JOIN Y ON C.cit = Y.cit"""


@register("c12_e1_citation_years", "SELECT * FROM (WITH S2 AS (SELECT 1), " + _CITE_SQL.format(y="nullif(yr, 'N/A')") + ")", views="S")
def citations(spark, sf):
    return D.citation_years(_citations(spark, sf), "CITATIONS", _references(spark, sf)).drop("CITATIONS")


@register("c12_citation_years_none_text",
          "SELECT * FROM (WITH S2 AS (SELECT 1), " + _CITE_SQL.format(y="nullif(CASE WHEN item_id IS NULL THEN 'None' ELSE yr END, 'N/A')") + ")", views="S")
def citations_none(spark, sf):
    return D.citation_years(_citations(spark, sf), "CITATIONS", _references(spark, sf), unknown="none_text").drop("CITATIONS")


@register("c13_reference_years",
          "SELECT sample_id, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE concat(CAST(1960 + l_partkey % 50 AS VARCHAR), '; ', CAST(1970 + l_suppkey % 40 AS VARCHAR)) END AS years FROM S", views="S")
def ref_years(spark, sf):
    s = samples(spark, sf).withColumn("ref", F.expr(
        "CASE WHEN l_partkey % 4 = 0 THEN 'no year here' ELSE concat('SMITH-JONES,  ', CAST(1960 + l_partkey % 50 AS STRING), '; DOE, ', CAST(1970 + l_suppkey % 40 AS STRING), ' p. 12') END"))
    return s.select("sample_id", T.reference_years("ref").alias("years"))


_BRANDS = {"Brand#1": "first", "Brand#2": "second"}


@register("c14_c15_c16_labels",
          """SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'first' WHEN 'Brand#2' THEN 'second' ELSE p_brand END AS recoded,
             CASE p_brand WHEN 'Brand#1' THEN 'first' WHEN 'Brand#2' THEN 'second' END AS short,
             nullif(upper(trim(p_type)), 'NAN') AS canonical FROM part""")
def recoded(spark, sf):
    p = table(spark, sf, "part").withColumn(
        "t", F.concat(F.lit("  "), F.lower("p_type"), F.lit(" ")))
    return p.select("p_partkey", T.recode("p_brand", _BRANDS).alias("recoded"),
                    T.abbreviate("p_brand", _BRANDS).alias("short"), T.canonical_label("t").alias("canonical"))


@register("c17_c18_c19_ratios",
          """SELECT sample_id, CASE WHEN m1 > 0 AND m3 > 0 THEN m1/m3 END AS pos, m1/nullif(m3-5,0) AS nz,
             CASE WHEN m1 > 0 THEN m1 END/CASE WHEN m3-5 > 0 THEN m3-5 END AS nz_pos, m1/nullif(m3-5,0) AS safe FROM S""",
          "pos nz nz_pos safe", "S")
def ratios(spark, sf):
    s = samples(spark, sf).withColumn("d", F.col("m3") - 5)
    return s.select("sample_id", N.ratio_pos("m1", "m3").alias("pos"), N.ratio_nz("m1", "d").alias("nz"),
                    N.ratio_nz("m1", "d", True).alias("nz_pos"), N.safe_ratio("m1", "d").alias("safe"))


_PATH = "CASE WHEN page_id % 5 = 0 THEN concat('AFRICA / KAAPVAAL CRATON_ARCHEAN / ', url) WHEN page_id % 5 = 1 THEN concat('SUPERIOR  PROVINCE - ARCHEAN/ ', url) WHEN page_id % 5 = 2 THEN '   ' WHEN page_id % 5 = 3 THEN concat('X / BALTIC SHIELD / ', CAST(page_id AS {s})) END"


@register("c20_region_from_path",
          "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'KAAPVAAL CRATON' WHEN page_id % 5 = 1 THEN 'SUPERIOR PROVINCE' WHEN page_id % 5 = 3 THEN 'BALTIC SHIELD' ELSE 'GeoROC_unmatched' END AS region FROM pages")
def region_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.craton_from_location(F.expr(_PATH.format(s="STRING"))).alias("region"))


@register("c21_clean_text",
          "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) END AS cleaned FROM documents")
def cleaned(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.clean_text(F.when(F.col("doc_id") % 17 == 0, " NaN ").otherwise(F.col("text"))).alias("cleaned"))


@register("c22_valid_coordinates",
          "SELECT sample_id, m1*4-100 AS lat, ((m2*7+180)::DOUBLE - floor((m2*7+180)/360)*360) - 180 AS lon FROM S WHERE m1*4-100 BETWEEN -90 AND 90", "lat lon", "S")
def coordinates(spark, sf):
    s = samples(spark, sf).select("sample_id", F.expr("m1*4-100 AS lat"), F.expr("m2*7 AS lon"))
    return C.valid_geo(s, "lat", "lon")


_PRINT = "concat_ws('|', " + ", ".join(
    f"CAST(coalesce(round_even({c}*1000.0, 0)/1000.0, -999999.0) AS VARCHAR)" for c in M) + ")"


@register("c23_fingerprint", f"SELECT sample_id, {_PRINT} AS fingerprint FROM S", views="S")
def fingerprints(spark, sf):
    return samples(spark, sf).select("sample_id", C.fingerprint(M).alias("fingerprint"))


def _log_sql(masked: bool) -> str:
    log = "CASE WHEN {c} > 0 THEN log10({c}) END" if masked else "log10(greatest({c}, 1e-12))"
    logs = {c: log.format(c=c) for c in ("m1", "m2", "m3")}
    z = {c: f"({logs[c]} - a{c})/s{c}" for c in logs}
    if masked:
        z = {c: f"coalesce({e}, 0.0)" for c, e in z.items()}
    stats = ", ".join(f"avg({e}) AS a{c}, stddev_pop({e}) AS s{c}" for c, e in logs.items())
    return (f"SELECT sample_id, {', '.join(f'{e} AS {c}' for c, e in z.items())} FROM S, "
            f"(SELECT {stats} FROM S WHERE source = 'F') r WHERE source = 'O'")


def _log(mode):
    def run(spark, sf):
        s = samples(spark, sf)
        _, app = C.log_standardize(s.where("source = 'F'"), s.where("source = 'O'"), ["m1", "m2", "m3"], mode)
        return app.select("sample_id", "m1", "m2", "m3")
    return run


register("c24_log_standardize_clip", _log_sql(False), "m1 m2 m3", "S")(_log("clip"))
register("c24_log_standardize_mask", _log_sql(True), "m1 m2 m3", "S")(_log("mask"))


@register("c25_resolve_age", "SELECT sample_id, coalesce(m3, m1)/1000.0 AS age_ga FROM S", "age_ga", "S")
def ages(spark, sf):
    s = samples(spark, sf).withColumnsRenamed({"m3": "C_AGE", "m1": "AGE"})
    return s.select("sample_id", N.resolve_age(["C_AGE", "AGE"], s.columns, in_ga=True).alias("age_ga"))


@register("c26_diagram_coordinates",
          """SELECT sample_id, 'ti_v' AS kind, m1*5994.0/1000.0 AS x, m2 AS y FROM S WHERE m1 IS NOT NULL AND m2 IS NOT NULL
             UNION ALL SELECT sample_id, 'nbyb_thyb', m2/m3, m4/m3 FROM S WHERE m2 > 0 AND m3 > 0 AND m4 > 0
             UNION ALL SELECT sample_id, 'zr_zry', m1, m1/m4 FROM S WHERE m1 > 0 AND m4 > 0""", "x y", "S", digits=10)
def diagrams(spark, sf):
    s = samples(spark, sf)
    names = {"TIO2": "m1", "V": "m2", "NB": "m2", "YB": "m3", "TH": "m4", "ZR": "m1", "Y": "m4"}
    return D.union_all(*[
        C.diagram_coords(s, kind, ["sample_id"], **names).withColumn("kind", F.lit(kind))
        for kind in ("ti_v", "nbyb_thyb", "zr_zry")])


@register("c30_component_tag",
          "SELECT sample_id, 'lines' AS \"SOURCE_DATASET\", CASE WHEN m2 <= 53 THEN 'low' ELSE 'high' END AS \"POOL_COMPONENT\" FROM S", views="S")
def tags(spark, sf):
    return C.tag_component(samples(spark, sf), "m2", "lines", "low", "high").select("sample_id", "SOURCE_DATASET", "POOL_COMPONENT")


_LABELS_SQL = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 0 THEN 'Unresolved' ELSE concat('Name ', lang) END AS canonical_craton,
             CASE WHEN doc_id % 3 = 0 THEN 'CRATON' WHEN doc_id % 3 = 1 THEN 'UNKNOWN' ELSE 'NOT_A_CRATON' END AS status,
             CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, {reason} AS reason FROM documents"""


def _answers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(
        """to_json(named_struct(
             'canonical_craton', CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 6 = 0 THEN 'Unresolved' ELSE concat('Name  ', lang) END,
             'status', CASE WHEN doc_id % 3 = 0 THEN ' craton' WHEN doc_id % 3 = 1 THEN 'odd' ELSE 'not_a_craton' END,
             'confidence', CASE WHEN doc_id % 2 = 0 THEN 'HIGH' ELSE 'sure' END,
             'reason', repeat('abcdefghij', cast(10 + doc_id % 10 as int))))""").alias("answer"))


@register("c31_sanitize_labels", _LABELS_SQL.format(reason="repeat('abcdefghij', 10 + doc_id % 10)"))
def sanitized(spark, sf):
    return D.sanitize_labels(_answers(spark, sf), "answer").drop("answer")


@register("c31_sanitize_labels_short", _LABELS_SQL.format(reason="substring(repeat('abcdefghij', 10 + doc_id % 10), 1, 160)"))
def sanitized_short(spark, sf):
    return D.sanitize_labels(_answers(spark, sf), "answer", reason_chars=160).drop("answer")


# --- D: filters -------------------------------------------------------------------------------

_PRESENT = "(" + "+".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in M) + ")"


@register("d1_min_present", f"SELECT sample_id FROM S WHERE {_PRESENT} >= 4", views="S")
def d1(spark, sf):
    return W.min_present(samples(spark, sf), M, 4).select("sample_id")


@register("d2_max_missing", f"SELECT sample_id, CAST(4 - {_PRESENT} AS INTEGER) AS missing_feature_count_36 FROM S WHERE 4 - {_PRESENT} < 2", views="S")
def d2(spark, sf):
    return W.max_missing(samples(spark, sf), M, 2).select("sample_id", "missing_feature_count_36")


@register("d3_drop_sparse", "SELECT sample_id FROM S WHERE CAST(m3 IS NOT NULL AS INTEGER)+CAST(m4 IS NOT NULL AS INTEGER) >= 1", views="S")
def d3(spark, sf):
    return W.drop_sparse(samples(spark, sf), ["m3", "m4"], 0.5).select("sample_id")


@register("d4_drop_all_missing",
          "SELECT sample_id, CAST(m3 IS NULL AS INTEGER)+CAST(m4 IS NULL AS INTEGER) AS n_missing FROM S WHERE m3 IS NOT NULL OR m4 IS NOT NULL", views="S")
def d4(spark, sf):
    return W.drop_all_missing(samples(spark, sf), ["m3", "m4"], count="n_missing").select("sample_id", "n_missing")


@register("d5_require", "SELECT sample_id FROM S WHERE m3-3 > 0 AND m4 > 0", views="S")
def d5(spark, sf):
    return W.require(samples(spark, sf).withColumn("m3", F.col("m3") - 3), ["m3", "m4"], True).select("sample_id")


@register("d6_composition_range",
          f"SELECT sample_id FROM S WHERE {FULL} AND m1/{SUM}*100.0 BETWEEN 20 AND 40 AND m2/{SUM}*100.0 BETWEEN 30 AND 70 AND (m4 < 5 OR m4 IS NULL)", views="S")
def d6(spark, sf):
    return W.composition_range(samples(spark, sf), M, {"m1": (20.0, 40.0), "m2": (30.0, 70.0)}, "m4").select("sample_id")


@register("d7_application_gate",
          f"""SELECT sample_id, {_closed(SEEN)}, CAST(4 - {_PRESENT} AS INTEGER) AS missing_feature_count_36 FROM S
              WHERE 4 - {_PRESENT} < 2 AND m1 > 0 AND m2 > 0 AND m1/{SEEN}*100.0 BETWEEN 20 AND 54 AND m2/{SEEN}*100.0 <= 70""",
          "m1 m2 m3 m4", "S")
def d7(spark, sf):
    return W.application_filter(samples(spark, sf), M, M, ["m1", "m2"], "m1", "m2", 20.0, 54.0, 70.0, 2).select(
        "sample_id", *M, "missing_feature_count_36")


@register("d8_allowed", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click','view') GROUP BY 1")
def d8(spark, sf):
    return W.allowed(table(spark, sf, "events"), "event_type", ARC).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("d9_locate_case",
          "SELECT sample_id FROM E WHERE \"Craton\" = 'unit 3' AND C_AGE BETWEEN 3000 AND 3100 AND contains(lower(pred_class_name), 'ew')", views="E")
def d9(spark, sf):
    area = W.CaseArea("demo", "Demo", 3.05, "unit 3", 3000.0, 3100.0, "EW")
    return W.locate_case(scored(spark, sf), area, reference="pred_class_name").select("sample_id")


_FUNNEL = [
    ("raw_input", "TRUE"), ("after_require_major_oxides", "m3 IS NOT NULL"),
    ("after_anhydrous_normalization_ready", FULL), ("after_sio2", f"m1/{SUM}*100.0 BETWEEN 20 AND 60"),
    ("after_mgo_al2o3", f"m2/{SUM}*100.0 BETWEEN 10 AND 70"), ("after_loi", "(m4 < 5 OR m4 IS NULL)"),
    ("after_min_non_nan", f"{_PRESENT} >= 4"),
]
_FUNNEL_SQL = " UNION ALL ".join(
    f"SELECT {i} AS step_no, '{name}' AS step, label, count(*) FILTER ({' AND '.join(c for _, c in _FUNNEL[: i + 1])}) AS n FROM S GROUP BY label"
    for i, (name, _) in enumerate(_FUNNEL))


@register("d10_filter_funnel", _FUNNEL_SQL, views="S")
def d10(spark, sf):
    params = W.FunnelParams(
        features=M, majors=M, required=["m3"], label="label", age=None, sio2="m1", sio2_range=(20.0, 60.0),
        pair_ranges={"m2": (10.0, 70.0)}, loi="m4", min_present=4)
    return W.filter_funnel(samples(spark, sf), params)[1]


@register("d11_iqr_filter",
          """SELECT sample_id FROM S, (SELECT quantile_cont(m1,0.25) a1, quantile_cont(m1,0.75) b1, quantile_cont(m3,0.25) a3, quantile_cont(m3,0.75) b3 FROM S) q
             WHERE NOT (coalesce(m1 < a1-0.4*(b1-a1) OR m1 > b1+0.4*(b1-a1), FALSE) OR coalesce(m3 < a3-0.4*(b3-a3) OR m3 > b3+0.4*(b3-a3), FALSE))""", views="S")
def d11(spark, sf):
    return W.iqr_filter(samples(spark, sf), ["m1", "m3", "absent"], 0.4).select("sample_id")


@register("d12_exclude_record", "SELECT sample_id FROM S WHERE NOT coalesce(l_suppkey = 7 AND m3 > 5, FALSE)", views="S")
def d12(spark, sf):
    return W.exclude_record(samples(spark, sf), (F.col("l_suppkey") == 7) & (F.col("m3") > 5)).select("sample_id")


@register("d13_valid_xy", "SELECT sample_id FROM S WHERE m3-2 > 0 AND m4-4 >= 0", views="S")
def d13(spark, sf):
    s = samples(spark, sf).withColumns({"x": F.col("m3") - 2, "y": F.col("m4") - 4})
    return W.valid_xy(s, "x", "y").select("sample_id")


@register("d14_class_quantile_band",
          "SELECT sample_id FROM S JOIN (SELECT label, quantile_cont(m2,0.2) lo, quantile_cont(m2,0.8) hi FROM S GROUP BY 1) q USING (label) WHERE m2 BETWEEN lo AND hi", views="S")
def d14(spark, sf):
    return W.class_quantile_band(samples(spark, sf), "label", "m2", 0.2, 0.8).select("sample_id")


# --- E: lookups -------------------------------------------------------------------------------


def _units(spark, sf):
    nation = table(spark, sf, "nation")
    return nation.select(
        F.concat(F.lit("crm|"), "n_name").alias("unit_id"), F.concat(F.lit("Unit of "), "n_name").alias("canonical_craton"),
        F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 'CRATON' ELSE 'UNKNOWN' END").alias("status"),
        F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'low' END").alias("confidence"),
        F.lit("table").alias("reason")).where("n_nationkey % 5 <> 4")


def _customers(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).select(
        "c_custkey", F.lit("crm").alias("SOURCE_DATASET"), F.col("n_name").alias("Craton"))


@register("e2_apply_unit_results",
          """SELECT c_custkey, 'crm' AS "SOURCE_DATASET", n_name AS "Craton_original",
             CASE WHEN k % 5 <> 4 AND k % 3 = 0 AND k % 2 = 0 THEN concat('Unit of ', n_name) ELSE n_name END AS "Craton",
             CASE WHEN k % 5 <> 4 THEN concat('Unit of ', n_name) ELSE '' END AS "Craton_AI",
             CASE WHEN k % 5 = 4 THEN '' WHEN k % 3 = 0 THEN 'CRATON' ELSE 'UNKNOWN' END AS "Craton_AI_status",
             CASE WHEN k % 5 = 4 THEN '' WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS "Craton_AI_confidence",
             CASE WHEN k % 5 = 4 THEN '' ELSE 'table' END AS "Craton_AI_reason"
             FROM (SELECT c_custkey, n_name, n_nationkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) t""")
def e2(spark, sf):
    return D.apply_unit_results(_customers(spark, sf), _units(spark, sf))


@register("e3_pending_units",
          "SELECT DISTINCT concat('crm|', n_name) AS unit_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 = 4")
def e3(spark, sf):
    done = D.completed_units(D.apply_unit_results(_customers(spark, sf), _units(spark, sf)), "c_custkey")
    units = _customers(spark, sf).select(D.unit_key("SOURCE_DATASET", "Craton").alias("unit_id")).distinct()
    return D.pending_units(units, done)


@register("e3_completed_units",
          """SELECT concat('crm|', n_name) AS unit_id, concat('Unit of ', n_name) AS canonical_craton, CASE WHEN n_nationkey % 3 = 0 THEN 'CRATON' ELSE 'UNKNOWN' END AS status,
             CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, 'table' AS reason
             FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey IN (SELECT c_nationkey FROM customer)""")
def e3b(spark, sf):
    return D.completed_units(D.apply_unit_results(_customers(spark, sf), _units(spark, sf)), "c_custkey")


@register("e5_cross_duplicates",
          f"SELECT label, count(*) AS n FROM (SELECT label, {_PRINT} AS fp FROM S WHERE source = 'O') b WHERE fp IN (SELECT {_PRINT} FROM S WHERE source = 'F') GROUP BY 1".replace("m2*", "round_even(m2,0)*"), views="S")
def e5(spark, sf):
    s = samples(spark, sf).withColumn("m2", F.rint("m2"))
    fp = s.select("sample_id", "label", "source", C.fingerprint(M, short=True).alias("fp"))
    return D.cross_duplicates(fp.where("source = 'F'"), fp.where("source = 'O'"), "fp").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("e6_attach_mask",
          "SELECT sample_id, CASE WHEN l_suppkey % 5 = 0 THEN CAST(0 AS TINYINT) ELSE CAST(m3 IS NULL AS TINYINT) END AS missing_mask__m3 FROM S", views="S")
def e6(spark, sf):
    s = samples(spark, sf).withColumn("made", F.col("l_suppkey") % 5 == 0)
    mask = X.missing_mask(s.where("NOT made"), ["m3"], keep=["sample_id"])
    return D.attach_mask(s.select("sample_id", "made"), mask, "sample_id", "made").drop("made")


# --- F: set operations, G1-G5, G9 -------------------------------------------------------------


@register("f1_union",
          "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def f1(spark, sf):
    n = table(spark, sf, "nation").toDF("key", "name", "region")
    return D.union_all(n, table(spark, sf, "region").toDF("key", "name"))


@register("f2_dedup_exact",
          "SELECT min(sample_id) AS sample_id, label, source, m1, round_even(m2,0) AS m2, m3 FROM S GROUP BY label, source, m1, round_even(m2,0), m3", views="S")
def f2(spark, sf):
    s = samples(spark, sf).select("sample_id", "label", "source", "m1", F.rint("m2").alias("m2"), "m3")
    return D.dedup_exact(s, "sample_id")


@register("f3_dedup_by_priority",
          """SELECT label, source, sample_id, m1, m3, copies FROM (SELECT *, row_number() OVER (PARTITION BY m1, m3, label ORDER BY source, sample_id) AS r,
             count(*) OVER (PARTITION BY m1, m3, label) AS copies FROM S) t WHERE r = 1""", views="S")
def f3(spark, sf):
    s = samples(spark, sf).select("sample_id", "source", "label", "m1", "m3")
    s = s.withColumn("key", F.concat_ws("|", "m1", F.coalesce(F.col("m3").cast("string"), F.lit("-")), "label"))
    return D.dedup_fingerprint(s, "key", ["source", "sample_id"]).drop("key")


@register("f4_internal_duplicates",
          "SELECT source, CAST(sum(c-1) AS BIGINT) AS n_duplicates FROM (SELECT source, m1, m3, label, count(*) AS c FROM S GROUP BY ALL) t GROUP BY 1", views="S")
def f4(spark, sf):
    s = samples(spark, sf).withColumn("key", F.concat_ws("|", "m1", F.coalesce(F.col("m3").cast("string"), F.lit("-")), "label"))
    return D.internal_duplicates(s, "key", ["source"])


@register("g1_label_counts",
          "SELECT coalesce(nullif(event_type, 'view'), 'UNKNOWN') AS label, count(*) AS count, count(*)*100.0/sum(count(*)) OVER () AS percent FROM events GROUP BY 1",
          "percent")
def g1(spark, sf):
    e = table(spark, sf, "events").withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return Z.label_counts(e, "event_type", 6)


_CONS = """
  O AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 9 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS sample,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS citation,
        CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey*1.5 + o_orderkey % 2 END AS DOUBLE) AS a,
        CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 + 0.5 END AS DOUBLE) AS b FROM orders),
  K AS (SELECT *, CASE WHEN sample IS NULL THEN ord END AS lone FROM O),
  T AS (SELECT sample, lone, citation, min(a) < max(a) OR min(b) < max(b) AS conflict, count(*) AS n, min(ord) AS ord,
        min_by(a, ord) FILTER (a IS NOT NULL) AS a, min_by(b, ord) FILTER (b IS NOT NULL) AS b FROM K GROUP BY 1, 2, 3)"""
_CONS_A = """SELECT ord, sample, citation, a, b FROM T WHERE NOT coalesce(conflict, FALSE)
  UNION ALL SELECT K.ord, K.sample, K.citation, K.a, K.b FROM K JOIN T ON K.sample IS NOT DISTINCT FROM T.sample
  AND K.lone IS NOT DISTINCT FROM T.lone AND K.citation IS NOT DISTINCT FROM T.citation WHERE T.conflict"""


def _orders(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS ord", "CASE WHEN o_custkey % 9 <> 0 THEN CAST(o_custkey AS STRING) END AS sample",
        "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS citation",
        "CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey*1.5 + o_orderkey % 2 END AS DOUBLE) AS a",
        "CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 + 0.5 END AS DOUBLE) AS b")


@register("g2_e4_consolidate_rows", f"SELECT * FROM (WITH Z AS (SELECT 1), {_CONS} {_CONS_A})", "a b")
def g2(spark, sf):
    return D.consolidate_rows(_orders(spark, sf), "sample", "citation", ["a", "b"], "ord")[0]


@register("g2_consolidate_counts",
          f"""SELECT * FROM (WITH Z AS (SELECT 1), {_CONS} SELECT count(*) FILTER (NOT coalesce(conflict, FALSE)) AS safe_groups,
              count(*) FILTER (conflict) AS conflict_groups, CAST(coalesce(sum(n) FILTER (conflict), 0) AS BIGINT) AS conflict_rows FROM T)""")
def g2c(spark, sf):
    return D.consolidate_rows(_orders(spark, sf), "sample", "citation", ["a", "b"], "ord")[1]


@register("g5_closure_stats",
          """SELECT stage, avg(t) AS mean, stddev_samp(t) AS std, min(t) AS min, max(t) AS max FROM (
             SELECT 'before' AS stage, m1+m2 AS t FROM S UNION ALL SELECT 'after', m1/(m1+m2)*100.0 + m2/(m1+m2)*100.0 FROM S) x GROUP BY 1""",
          "mean std min max", "S")
def g5(spark, sf):
    return C.normalization_stats(samples(spark, sf), ["m1", "m2"])


@register("g9_missing_profile",
          " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_missing, 100.0*count(*) FILTER ({c} IS NULL)/count(*) AS missing_pct FROM S" for c in M),
          "missing_pct", "S")
def g9(spark, sf):
    return X.missing_profile(samples(spark, sf), M)


@register("g30_archean_stats",
          """SELECT (SELECT count(*) FROM documents) AS raw_rows, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS raw_age_text_archean_rows,
             (SELECT count(DISTINCT doc_id % 100) FROM documents) AS consolidated_rows,
             (SELECT count(*) FROM (SELECT min(doc_id) AS d FROM documents GROUP BY doc_id % 100) t WHERE d % 3 = 0) AS consolidated_age_text_archean_rows""")
def g30(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "doc_id % 100 AS key", "CASE WHEN doc_id % 3 = 0 THEN 'Archean' END AS age", "lang AS prefix")
    first = D.dedup_fingerprint(d, "key", ["doc_id"])
    return G.archean_stats(d, first, "age", "prefix")
