"""A sample of registered queries against their SQL twins; the whole set is run by
tools/check_oracle.py."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "nation region customer supplier part orders lineitem events documents embeddings pages benchmark".split()
SOME = ["flagship_age_shares", "d10_filter_funnel", "g2_e4_consolidate_rows", "i1_train_val_test", "g6_fit_boundaries",
        "g10_summarize_by_age", "g31_build_units", "h10_ks_two_sample", "k3_average_precision", "l4_shap_direction",
        "m1_weighted_bootstrap", "m5_mass_level"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data, cols):
    at = [names.index(c) for c in cols]
    def show(v):
        if isinstance(v, float):
            return f"{v + 0.0:.5e}"
        return "~" if v is None else str(v)
    return sorted(tuple(show(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert rows(df.columns, [tuple(r) for r in df.collect()], cols) == rows(names, cur.fetchall(), cols)


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 140


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
