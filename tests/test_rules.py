"""Tiny rows that pin a rule."""

import pytest
from pyspark.sql import functions as F

from assaylake.functions import numeric as N
from assaylake.functions import text as T
from assaylake.operators import balance, composition, dedup, encode, filters, schema, summaries
from assaylake.sources import tables


def one(df):
    return df.first()


@pytest.mark.parametrize("cells,elemental,expected,rule", [
    ({"FE2O3T": "10"}, False, 8.998, "Fe2O3T"),
    ({"FEO": "5", "FE2O3": "2"}, False, 6.7996, "FeO+Fe2O3"),
    ({"FE": "7"}, False, None, None),
    ({"FE": "7"}, True, 7.0, "Fe"),
    ({"FEOT": "bad", "FEO": "nan", "FE2O3": "1"}, False, 0.8998, "Fe2O3"),
])
def test_iron_priority(spark, cells, elemental, expected, rule):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{c} string" for c in cells))
    row = one(composition.calculate_feot(df, elemental))
    assert row["FEOT(WT%)"] == (pytest.approx(expected) if expected is not None else None)
    assert row["feot_source"] == rule


def test_closure_modes(spark):
    df = spark.createDataFrame([(1, 20.0, 30.0, 0.0), (2, 10.0, None, 10.0), (3, None, None, None)],
                               "id int, a double, b double, c double")
    cols = ["a", "b", "c"]
    strict = {r.id: r for r in composition.anhydrous(df, cols, "strict").collect()}
    assert strict[1].valid and strict[1].a == 40.0 and strict[1].c == 0.0
    assert not strict[2].valid and strict[2].a is None
    positive = {r.id: r for r in composition.anhydrous(df, cols, "positive").collect()}
    assert positive[1].c is None and positive[1].a == pytest.approx(40.0)
    assert positive[3].a is None
    seen = {r.id: r for r in composition.anhydrous(df, cols, "observed").collect()}
    assert seen[2].a == 50.0 and seen[3].a is None
    with pytest.raises(ValueError):
        composition.anhydrous(df, cols, "raise")
    with pytest.raises(ValueError):
        composition.anhydrous(df, cols, "positive", must_have_total=True)


def test_closed_in_bounds_agrees_with_parts(spark):
    df = spark.createDataFrame([(20.0, 30.0), (0.0, 0.0), (None, 1.0), (45.0, 55.0)], "a double, b double")
    got = [r[0] for r in df.select(composition.closed_in_bounds(["a", "b"], {"a": (40.0, 45.0)})).collect()]
    assert got == [True, None, None, True]


def test_text_rules(spark):
    df = spark.createDataFrame([(
        "PROTEROZOIC [12] [7]", "SMITH, 1999; DOE, 1999", "AFRICA / KAAPVAAL CRATON_ARCHEAN / BARBERTON", " ", "  a \n b ")],
        "age string, ref string, loc string, blank string, txt string")
    row = one(df.select(
        T.clean_age("age"), T.reference_years("ref"), T.craton_from_location("loc"), T.craton_from_location("blank"),
        T.clean_text("txt"), T.first_int("age"), T.is_archean("age", "loc"), T.craton_from_location(F.lit("/ /"))))
    assert list(row) == ["PROTEROZOIC", "1999; 1999", "KAAPVAAL CRATON", "GeoROC_unmatched", "a b", 12.0, True, "GeoROC_unmatched"]


def test_citations(spark):
    refs = spark.createDataFrame([(1, "1999.0"), (2, "1987"), (3, "N/A")], "reference_number int, year string")
    df = spark.createDataFrame([(1, "[1][2][1]"), (2, None), (3, "[3]"), (4, "[9]")], "id int, c string")
    years = {r.id: r.PUBLICATION_YEAR for r in dedup.citation_years(df, "c", refs).collect()}
    assert years == {1: "1987; 1999", 2: "N/A", 3: "N/A", 4: "N/A"}
    texts = {r.id: r.PUBLICATION_YEAR for r in dedup.citation_years(df, "c", refs, unknown="none_text").collect()}
    assert texts[4] == "None"


def test_consolidation(spark):
    rows = [(1, "x", "c", 1.0, None), (2, "x", "c", None, 2.0), (3, "y", None, 1.0, None), (4, "y", None, 3.0, None),
            (5, None, "c", 1.0, None), (6, None, "c", 1.0, None)]
    df = spark.createDataFrame(rows, "o int, s string, cit string, a double, b double")
    out, stats = dedup.consolidate_rows(df, "s", "cit", ["a", "b"], "o")
    assert sorted((r.o, r.a, r.b) for r in out.collect()) == [(1, 1.0, 2.0), (3, 1.0, None), (4, 3.0, None), (5, 1.0, None), (6, 1.0, None)]
    assert tuple(one(stats)) == (3, 1, 2)
    same, none = dedup.consolidate_rows(df, "absent", "cit", ["a"], "o")
    assert same.count() == 6 and tuple(one(none)) == (0, 0, 0)


def test_sparse_limit_is_cut(spark):
    cols = [f"c{i}" for i in range(36)]
    rows = [tuple([1.0] * n + [None] * (36 - n)) for n in (7, 6)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    assert filters.drop_sparse(df, cols, 0.8).count() == 1


def test_boundaries_and_codes(spark):
    df = spark.range(510).select(F.col("id").cast("double").alias("x"))
    bounds = encode.collect_boundaries(encode.fit_boundaries(df, ["x"]))["x"]
    assert len(bounds) == 254 and bounds[0] == 2.0
    probe = spark.createDataFrame([(1e9,), (-5.0,), (2.0,), (2.5,)], "x double")
    assert [r.x for r in encode.quantile_encode(probe, {"x": bounds}).collect()] == [255, 1, 1, 2]
    ties = spark.createDataFrame([(2.0,)], "x double")
    assert one(encode.quantile_encode(ties, {"x": [1.0, 2.0, 2.0, 3.0]})).x == 2
    empty = spark.createDataFrame([(None,)], "x double")
    assert one(encode.quantile_encode(empty, {"x": bounds}, "zero")).x == 0
    with pytest.raises(Exception, match="missing value"):
        encode.quantile_encode(empty, {"x": bounds}, "error").collect()


def test_codes_match_searchsorted(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    bounds = np.sort(rng.integers(0, 60, 254)).astype(float)
    values = rng.uniform(-5, 65, 500)
    values[::7] = bounds[: len(values[::7])]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").coalesce(1)
    got = [r.x for r in encode.quantile_encode(df, {"x": bounds.tolist()}).collect()]
    assert got == (np.searchsorted(bounds, values, side="left") + 1).clip(1, 255).tolist()


def test_age_bins(spark):
    df = spark.createDataFrame([(2500.0,), (2699.9,), (2700.0,), (None,)], "a double")
    rows = summaries.add_age_bins(df, "a", 200).collect()
    assert [r.age_bin.lo if r.age_bin else None for r in rows] == [2400.0, 2600.0, 2600.0, None]
    assert rows[0].age_bin_label == "2.4–2.6 Ga" and rows[3].age_bin_label == ""


def test_schema_rules(spark):
    df = spark.createDataFrame([("1", "2")], "`Na2O (wt%)` string, `MG_O` string")
    out = schema.add_standard_columns(df, ["NA2O(WT%)", "MGO(WT%)"], {"MGO(WT%)": ["MGO"]})
    assert one(out)["MGO(WT%)"] == "2" and one(out)["NA2O(WT%)"] == "1"
    with pytest.raises(KeyError):
        schema.add_standard_columns(df, ["K2O(WT%)"])
    with pytest.raises(ValueError):
        schema.normalize_names(df.toDF("a(1)", "A"))
    with pytest.raises(ValueError):
        schema.validate_features(spark.createDataFrame([(float("nan"),)], "x double"), ["x"])
    with pytest.raises(ValueError):
        schema.expect_rows(df, 2)


def test_number_reading(spark):
    df = spark.createDataFrame([("1.5",), ("bad",), ("nan",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(N.to_number("x")).collect()] == [1.5, None, None, None, None]
    half = spark.createDataFrame([(0.0005,), (0.0015,), (2.5,)], "x double")
    assert [r[0] for r in half.select(N.round_half_even("x", 3)).collect()][:2] == [0.0, 0.002]


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name,v\ncafé,1\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("﻿name,v\ncafé,1\n".encode("utf-8"))
    for f in ("l.csv", "u.csv"):
        row = one(tables.read_csv_fallback(spark, str(tmp_path / f)))
        assert row["name"] == "café" and row["v"] == "1"


def test_csv_folder_of_mixed_files(spark, tmp_path):
    """Each file by its own bytes, in names with spaces too; a genuine U+FFFD stays; cells hold line breaks and quotes."""
    folder = tmp_path / "mixed files"
    folder.mkdir()
    (folder / "a b.csv").write_bytes("id,naïve\n1,\"café\nau lait\"\n".encode("latin-1"))
    (folder / "c%20d.csv").write_bytes("id,naïve\n2,\"say \"\"é\"\"\"\n".encode("latin-1"))
    (folder / "u.csv").write_bytes("\ufeffid,naïve\n3,odd \ufffd café\n4,\n".encode("utf-8"))
    got = {r["id"]: r["naïve"] for r in tables.read_csv_fallback(spark, str(folder)).collect()}
    assert got == {"1": "café\nau lait", "2": 'say "é"', "3": "odd \ufffd café", "4": None}
    with pytest.raises(ValueError, match="not UTF-8"):
        tables.read_csv_fallback(spark, str(folder), ("UTF-8", "utf-8-sig"))


def test_csv_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, 'é "x"\ny'), (2, None)], "`a b` int, t string").repartition(2)
    path = tables.write_table(df, str(tmp_path / "out"), "csv", encoding="utf-8-sig")
    files = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".csv"]
    assert files and all(f.read_bytes().startswith("\ufeffa b,t".encode("utf-8")) for f in files)
    back = tables.read_csv_fallback(spark, path)
    assert back.columns == ["a b", "t"]
    assert sorted(map(tuple, back.collect())) == [("1", 'é "x"\ny'), ("2", None)]
    tables.write_table(df.limit(0), path, "csv")
    assert tables.read_csv_fallback(spark, path).count() == 0


def test_oversampling_targets():
    assert balance.sampling_strategy({"a": 5, "b": 9}, {"a": 7, "b": 9}) == {"a": 7}
    assert balance.sampling_strategy({"a": 5, "b": 9}, 8) == {"a": 8}
    with pytest.raises(ValueError):
        balance.sampling_strategy({"a": 5}, {"z": 9})
    assert balance.parse_targets("x=y=3\n\n b = 2") == {"x=y": 3, "b": 2}
    with pytest.raises(ValueError):
        balance.parse_targets("nope")


def test_injected_predictor(spark):
    from pyspark.ml.linalg import Vectors

    from assaylake.operators import score

    def make():
        import numpy as np

        return lambda x: np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)

    df = spark.createDataFrame([(i, Vectors.dense([float(i), 0.0])) for i in range(5)], ["id", "features"])
    rows = score.score_batches(df, "features", make, 2, batch_size=2).collect()
    assert all(r.probs[0] + r.probs[1] == pytest.approx(1.0) for r in rows)
    named = score.add_prediction_columns(
        spark.createDataFrame([([0.5, 0.5], [0.05, 0.0])], "p array<double>, s array<double>"), "p", ["x", "y"], "s", ["x"])
    assert one(named).confidence_tier == "high" and one(named).pred_class_name == "x"


def test_calibration_edge_belongs_to_lower_bin(spark):
    from assaylake.operators import evaluate

    df = spark.createDataFrame([(0, [0.1] * 10)], "y int, probs array<double>")
    assert one(evaluate.ece(df, "y", "probs")).ece == pytest.approx(0.9)


def test_unit_results(spark):
    df = spark.createDataFrame([("s", " Old  name "), ("s", None)], "SOURCE_DATASET string, Craton string")
    res = spark.createDataFrame([("s|Old name", "New", "CRATON", "medium", "r")],
                                "unit_id string, canonical_craton string, status string, confidence string, reason string")
    rows = {r.Craton_original: r for r in dedup.apply_unit_results(df, res).collect()}
    assert rows[" Old  name "].Craton == "New" and rows[None].Craton == "Unresolved" and rows[None].Craton_AI == ""
