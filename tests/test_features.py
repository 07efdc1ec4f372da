"""Selection scores, quantiles and ranks against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom import errors
from tabloom.core import Dataset
from tabloom.functions import average_ranks, linear_quantiles, nearest_quantiles
from tabloom.operators import operator
from tabloom.operators.features import discordant


def plain_tau(x, y):
    s = [(np.sign(a - c), np.sign(b - d)) for (a, b), (c, d) in itertools.combinations(zip(x, y), 2)]
    more = sum(p * q for p, q in s)
    return more / math.sqrt(sum(p != 0 for p, _ in s) * sum(q != 0 for _, q in s))


def test_discordant_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        y, w = rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n)
        assert discordant(y, w) == sum(w[i] * w[j] for i, j in itertools.combinations(range(n), 2) if y[i] > y[j])


@pytest.mark.parametrize("range_rows", [200_000, 20])
def test_kendall_is_exact(spark, monkeypatch, range_rows):
    rng = np.random.default_rng(2)
    kind = operator("SelectUnivariateKendall")
    monkeypatch.setattr(kind, "range_rows", range_rows)
    x = rng.integers(0, 12, 150).astype(float)
    frame = pd.DataFrame({"a": x, "b": rng.normal(size=150), "c": np.where(rng.random(150) < 0.6, 3.0, x), "y": x * 2 + rng.integers(-9, 9, 150)})
    stage = kind(n_features=1).fit(Dataset(spark.createDataFrame(frame), target="y"))
    for c in "abc":
        assert stage.found[c] == pytest.approx(plain_tau(frame[c], frame["y"])), c


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(0, 30, 400), rng.normal(size=333)]).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": v})).withColumn("none", F.lit(None).cast("double")).withColumn("i", F.lit(4))
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = linear_quantiles(df, ["v", "none", "i"], qs)
    assert got["v"] == pytest.approx(np.quantile(v, qs).tolist()) and got["none"] == [] and got["i"] == [4.0] * 6
    s = np.sort(v)
    near = nearest_quantiles(df, ["v", "none"], qs)
    assert near["v"] == [s[int(x * (len(v) - 1) + 0.5)] for x in qs] and near["none"] == [None] * 6


def test_quantiles_compute_a_column_in_one_pass(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(i):
        met.add(1)
        return i * 7 % 501 / 2

    df = spark.range(501).select(slow("id").alias("v"))
    assert linear_quantiles(df, ["v"], [0.5, 0.9])["v"] == pytest.approx(np.quantile(np.arange(501) / 2, [0.5, 0.9]).tolist())
    assert met.value <= 2 * 501  # once to leave out nulls, once for its value


def test_average_ranks(spark):
    v = [3.0, 1.0, 3.0, 2.0, None, 1.0, 1.0, 9.0] * 20
    got = sorted((tuple(r) for r in average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v", "rank").collect() if r["v"] is not None))
    want = pd.Series([x for x in v if x is not None]).rank() + v.count(None)
    assert [r for _, r in got] == sorted(want)


@pytest.mark.parametrize("by", [None, ["g"]])
def test_ordered_fills(spark, by):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": rng.permutation(300), "g": rng.integers(0, 3, 300), "v": np.where(rng.random(300) < 0.6, np.nan, rng.normal(size=300))})
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)
    ordered = frame.sort_values("k")
    groups = ordered.groupby("g")["v"] if by else ordered["v"]
    plain = {"FillNoneForward": lambda: groups.ffill(), "FillNoneBackward": lambda: groups.bfill()}
    inner = lambda s: pd.Series(np.interp(np.arange(len(s)), np.flatnonzero(s.notna()), s.dropna(), left=np.nan, right=np.nan), s.index)
    plain["FillNoneInterpolation"] = lambda: groups.transform(inner) if by else inner(groups)
    for name, want in plain.items():
        out = operator(name)(["v"], order_by=["k"], partition_by=by).fit_transform(Dataset(df)).df
        assert out.columns == ["k", "g", "v"]
        got = out.orderBy("k").toPandas()["v"].to_numpy(dtype=float)
        assert np.allclose(got, want().to_numpy(dtype=float), equal_nan=True), name
        with pytest.raises(errors.FitError):
            operator(name)(["v"]).fit(Dataset(df))


@pytest.mark.parametrize("by", [None, ["g"]])
@pytest.mark.parametrize("name", ["FillNoneBackward", "FillNoneInterpolation"])
def test_fills_from_behind_read_no_row_again(spark, name, by):
    df = spark.range(20_000).select("id", F.lit(1).alias("g"), F.when(F.col("id") % 5_000 == 4_999, F.col("id").cast("double")).alias("v"))
    out = operator(name)(["v"], order_by=["id"], partition_by=by).fit_transform(Dataset(df)).df
    frames = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in frames and "unboundedfollowing" not in frames  # the latter's work grows with the square of a window's rows
    want = lambda i: float(i // 5_000 * 5_000 + 4_999) if name == "FillNoneBackward" else float(i) if i >= 4_999 else None
    assert [(r["id"], r["v"]) for r in out.orderBy("id").collect()] == [(i, pytest.approx(want(i))) for i in range(20_000)]


def test_codes_of_many_values(spark, monkeypatch):
    from tabloom.operators import basic

    monkeypatch.setattr(basic, "MOST_VALUES", 300)
    rows = [(f"v{i % 700:03d}", f"w{i % 280:03d}", "few" if i % 2 else None) for i in range(1400)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    stage = operator("EncodeInt")()
    out = stage.fit_transform(Dataset(df))
    assert sorted(map(tuple, out.df.distinct().collect()), key=str) == sorted({(i % 700, i % 280, 0 if i % 2 else None) for i in range(1400)}, key=str)
    back = stage.inverse_transform(out).df
    assert back.columns == ["a", "b", "c"] and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    new = stage.transform(Dataset(spark.createDataFrame([("zzz", "w001", None), (None, "?", "few")], "a string, b string, c string"))).df.collect()
    assert sorted(map(tuple, new), key=str) == sorted([(-1, 1, None), (None, -1, 0)], key=str)
    with pytest.raises(errors.FitError):
        operator("EncodeOneHot")().fit(Dataset(df))
    assert operator("EncodeOneHotOrHash")().fit_transform(Dataset(df)).df.columns == ["a", "b", "c_few", "c_None"]
