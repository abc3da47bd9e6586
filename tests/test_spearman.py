"""Rank correlation of complete columns."""

import math

import pandas as pd
import pytest
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from assaylake.operators import domain


def test_matrix_equals_average_ranks(spark, monkeypatch):
    """Ties, negative, missing and infinite cells rank as in pandas; cells are not sorted as one list of rows."""
    monkeypatch.setattr(Correlation, "corr", None)
    rows = [(float(i * 37 % 101), float(i * i % 13) - 2, None if i % 9 == 0 else float("inf") if i % 50 == 0 else i * 0.5, 3.0) for i in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = domain.spearman_matrix(df.repartition(5), list("abcd"))
    x = pd.DataFrame(rows, columns=list("abcd")).fillna(0.0).clip(lower=1e-12).rank()
    want = x.corr()
    assert set(got) == {(p, q) for i, p in enumerate("abcd") for q in "abcd"[i + 1:]}
    for (p, q), r in got.items():
        assert math.isnan(r) if q == "d" else r == pytest.approx(want.loc[p, q], abs=1e-12)
    assert math.isnan(domain.spearman_matrix(df.where(F.col("a") < 0), ["a", "b"])["a", "b"])
