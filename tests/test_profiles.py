"""Ranks and places over values with ties, nulls and many cells, against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from skirmish.operators import profiles


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    values = [None if v % 11 == 0 else float(v // 3) for v in rng.integers(0, 900, 2_000)]
    values[:700] = [40.0] * 700
    return pd.DataFrame({"name": [f"p{k:04d}" for k in range(2_000)], "x": pd.array(values, "Float64"), "y": rng.random(2_000).round(2)})


def _frame(spark, rows):
    data = [(n, None if pd.isna(x) else float(x), float(y)) for n, x, y in rows.itertuples(index=False)]
    return spark.createDataFrame(data, "name string, x double, y double").repartition(7)


def test_ranks_are_shares_of_rows_not_above(spark, rows):
    found = profiles.percentile_ranks(_frame(spark, rows), ["x"], "name").toPandas().set_index("name").x_rank
    wanted = rows.set_index("name").x.astype(float).rank(method="max", pct=True).mul(100).fillna(50.0)
    pd.testing.assert_series_equal(found.sort_index(), wanted.sort_index(), check_names=False)


def test_running_counts_within_groups(spark, rows):
    counted = _frame(spark, rows).where("x IS NOT NULL").selectExpr("substr(name, 5, 1) AS g", "x").groupBy("g", "x").count()
    found = profiles.running_counts(counted, "x", "count", ["g"], cells=8).toPandas().sort_values(["g", "x"])
    assert (found.groupby("g")["count"].cumsum() == found["_end"]).all()
    assert (found.groupby("g")["count"].transform("sum") == found["_n"]).all()


def test_places_are_those_of_one_sort(spark, rows):
    found = profiles.composite(_frame(spark, rows), {"x": 0.5}, {"y": 0.5}, "name").toPandas()
    wanted = found.sort_values(["rating", "name"], ascending=[False, True]).place
    assert list(wanted) == list(range(1, len(rows) + 1))


def test_quartiles_are_cut_by_place(spark, rows):
    found = profiles.quartile_means(_frame(spark, rows), "x", ["y"], "name").toPandas().sort_values("quartile")
    placed = rows.sort_values(["x", "name"], na_position="first").reset_index(drop=True)
    wanted = placed.y.groupby(placed.index // 500).mean()
    assert list(found.n) == [500] * 4
    np.testing.assert_allclose(found.y, wanted)


def test_without_rows(spark, rows):
    none = _frame(spark, rows).where("false")
    assert profiles.percentile_ranks(none, ["x"], "name").count() == 0
    assert profiles.composite(none, {"x": 1.0}, {}, "name").count() == 0
    assert profiles.percentile_points(none, ["x"], [50]).count() == 0
