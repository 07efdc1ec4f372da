"""Class balance and neighbours: whole tables, all dimensions, and results that do not depend on the number of rows."""

import numpy as np
import pandas as pd
import pytest

from tabloom.core import Dataset
from tabloom.functions.knn import Blocks, nearest, nearest_everywhere, references
from tabloom.operators import operator
from tabloom.plans import catalogue

SF = "/root/testdata/sf0.001"
BALANCE = ("oversample_smote", "oversample_adasyn", "oversample_smote_or_random", "undersample_enn", "undersample_tomek", "undersample_nearmiss", "undersample_cluster_centroids")


@pytest.mark.parametrize("name", [*BALANCE, "fill_none_knn"])
def test_balance_queries_take_the_whole_table(spark, name):
    """What each query hands to its operator: all rows, all classes, all dimensions."""
    given = {}

    def seen(ds):
        given["df"] = ds.df
        raise InterruptedError

    class Spy:
        fit_transform = staticmethod(seen)

    before, catalogue.operator = catalogue.operator, lambda stage: lambda **params: Spy
    try:
        with pytest.raises(InterruptedError):
            catalogue.QUERIES[name](spark, SF)
    finally:
        catalogue.operator = before
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert given["df"].count() == table.count() == 500
    assert {f"e{i}" for i in range(64)} <= set(given["df"].columns)
    if name in BALANCE:
        assert given["df"].select("label").distinct().count() == table.select("label").distinct().count() == 10


def test_references_are_never_thinned(spark):
    x, carried, keys = references(spark.range(50_300).selectExpr("id AS a", "cast(id % 3 AS string) AS y"), ["a"], ["y"])
    assert sorted(x[:, 0].astype(int)) == list(range(50_300)) and len(carried) == len(keys) == 50_300


def test_enn_and_tomek_beyond_fifty_thousand_rows(spark):
    """On a line with gaps 1, 3, 2, 1, 3, 2 ... each row's nearest neighbour is known, in integers and without ties."""
    n = 50_300
    at = np.concatenate([[0], np.cumsum(np.resize([1, 3, 2], n - 1))])
    y = np.where(np.arange(n) * 7919 % 10 < 3, "a", "b")
    gap = np.concatenate([[np.inf], np.diff(at), [np.inf]])
    near = np.arange(n) + np.where(gap[:-1] < gap[1:], -1, 1)
    want = {
        "UndersampleENN": (y[near] == y) | (y == "a"),
        "UndersampleTomekLinks": ~((near[near] == np.arange(n)) & (y[near] != y) & (y != "a")),
    }
    df = spark.createDataFrame(pd.DataFrame({"at": at, "y": y})).repartition(8)
    for name, keep in want.items():
        stage = operator(name)(**({"n_neighbors": 2} if name == "UndersampleENN" else {}))
        got = sorted(r["at"] for r in stage.fit_transform(Dataset(df, target="y")).df.collect())
        assert 0 < len(got) < n and got == at[keep].tolist(), name


def test_nearest_over_blocks_leaves_out_the_row_itself(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (300, 3)).astype(float)  # many equal rows and equal distances
    keys = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    sc = spark.sparkContext
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.sqrt(np.sort(d, axis=1)[:, :4])
    for refs in (x, Blocks(sc, x, 3 * 50)):
        distance, index = nearest(x, refs, 4, keys, keys)
        assert np.array_equal(distance, want) and np.array_equal(np.sqrt(((x[:, None] - x[index]) ** 2).sum(2)), want)
    assert np.array_equal(nearest(x, x, 4)[1], nearest(x, Blocks(sc, x, 3 * 50), 4)[1])
    assert np.array_equal(nearest_everywhere(sc, x, keys, x, keys, 4), nearest(x, x, 4, keys, keys)[1])
    assert np.array_equal(Blocks(sc, x, 3 * 50).take(index), x[index])


def test_knn_fill_over_blocks(spark):
    x = np.random.default_rng(5).random((200, 3))
    x[::7, 1] = np.nan
    stage = operator("FillNoneKNN")(["a", "b", "c"], n_neighbors=3)
    got = stage.fit_transform(Dataset(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])))).df.toPandas().to_numpy()
    have = x[~np.isnan(x[:, 1])]
    for r, row in zip(got, x):
        by = ((have[:, [0, 2]] - row[[0, 2]]) ** 2).sum(1)
        assert r[1] == pytest.approx(row[1] if not np.isnan(row[1]) else have[np.argsort(by)[:3], 1].mean())
