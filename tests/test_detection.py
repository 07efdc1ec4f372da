"""Outlier, balance and embedding operators against plain versions and on frames whose answer is known."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tabloom.core import Dataset
from tabloom.functions.knn import nearest
from tabloom.operators import detection, manifold, operator
from tabloom.operators.features import signed


def frame(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame({**{f"x{j}": x[:, j] for j in range(x.shape[1])}, **more}))


def got(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(size=(150, 2)), [[9, 9], [-8, 7], [10, -9]]])


def test_isolation_scores_by_walking():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(64, 3))
    trees = [detection.grow(x[rng.choice(64, 32, replace=False)], rng) for _ in range(7)]

    def depth(row, feature, cut, length):
        at = 1
        while feature[at] >= 0:
            at = 2 * at + int(row[feature[at]] > cut[at])
        return length[at]

    norm = lambda n: 2 * (sum(1 / i for i in range(1, n))) - 2 * (n - 1) / n
    assert float(detection.path_norm(500)) == pytest.approx(norm(500), abs=5e-3)
    want = [2 ** (-np.mean([depth(r, *t) for t in trees]) / float(detection.path_norm(32))) for r in x]
    assert detection.isolation(x, trees, 32) == pytest.approx(want)


def test_outliers_go(spark, cloud):
    for name, least in (("RemoveOutliersIsolationForest", 100), ("RemoveOutliersLocalOutlierFactor", 90)):
        out = got(operator(name)().fit_transform(Dataset(frame(spark, cloud))).df)
        assert least <= len(out) <= 150 and not {tuple(r) for r in cloud[150:].tolist()} & set(out), name
        assert sorted(out) == sorted(got(operator(name)().fit_transform(Dataset(frame(spark, cloud).repartition(5))).df)), name


def test_local_factor_by_hand(spark, cloud):
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = d.argsort(1)[:, :2]
    far = np.take_along_axis(d, near, 1).max(1)
    density = [1 / (np.mean([max(far[o], d[i, o]) for o in near[i]]) + 1e-10) for i in range(len(d))]
    factor = [np.mean([density[o] for o in near[i]]) / density[i] for i in range(len(d))]
    want = sorted(map(tuple, cloud[np.array(factor) <= 1.5].tolist()))
    assert sorted(got(operator("RemoveOutliersLocalOutlierFactor")().fit_transform(Dataset(frame(spark, cloud))).df)) == want


def test_one_class_boundary(spark, cloud):
    gamma = 1 / (2 * cloud.var())
    k = detection.gaussian(cloud, cloud, gamma)
    for nu in (0.2, 0.5):
        a, offset = detection.one_class(k, nu, 1e-8)
        most, g = 1 / (nu * len(k)), k @ a
        assert a.sum() == pytest.approx(1) and a.min() >= 0 and a.max() <= most + 1e-12
        assert g[a < most - 1e-9].min() >= g[a > 1e-9].max() - 1e-6  # no weight could move for the better
        out = operator("RemoveOutliersOneClassSVM")(nu=nu).fit_transform(Dataset(frame(spark, cloud))).df.count()
        assert out == pytest.approx((1 - nu) * len(cloud), abs=6)


@pytest.fixture(scope="module")
def classes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(2, 1, (25, 2)), rng.normal(-2, 1, (12, 2))])
    y = ["a"] * 60 + ["b"] * 25 + ["c"] * 12
    kind = [f"k{int(v)}" for v in rng.integers(0, 3, 97)]
    return x, y, kind


def test_made_rows_lie_between_neighbours(spark, classes):
    x, y, kind = classes
    df = frame(spark, x, y=y, kind=kind)
    for name in ("OversampleSMOTE", "OversampleSMOTENC", "OversampleADASYN"):
        stage = operator(name)()
        out = stage.fit_transform(Dataset(df.drop("kind") if name != "OversampleSMOTENC" else df, target="y")).df
        rows = out.toPandas()
        if name != "OversampleADASYN":
            assert Counter(rows["y"]) == {"a": 60, "b": 60, "c": 60}
        for c in "bc":
            own = x[np.array(y) == c]
            new = rows[rows["y"] == c][["x0", "x1"]].to_numpy()
            old = {tuple(r) for r in own.tolist()}
            made = [r for r in new if tuple(r) not in old]
            assert made
            for r in made:  # on a line between a row and one of its class
                gap = own[:, None] - r, own[None] - r
                cross = np.abs(gap[0][..., 0] * gap[1][..., 1] - gap[0][..., 1] * gap[1][..., 0])
                between = (gap[0] * gap[1]).sum(2) <= 1e-12
                assert (cross[between] < 1e-9).any(), name
        again = operator(name)().fit_transform(Dataset((df.drop("kind") if name != "OversampleSMOTENC" else df).repartition(4), target="y")).df
        assert sorted(map(str, got(again))) == sorted(map(str, got(out)))
        if name == "OversampleSMOTENC":
            assert set(rows["kind"]) <= {"k0", "k1", "k2"}


def test_smoten_takes_the_frequent_value(spark):
    rows = [("u", "p", "big")] * 30 + [("v", "q", "small")] * 5 + [("v", "r", "small")]
    out = operator("OversampleSMOTEN")().fit_transform(Dataset(spark.createDataFrame(rows, "f string, g string, y string"), target="y")).df
    counts = Counter(got(out))
    assert counts[("u", "p", "big")] == 30 and counts[("v", "q", "small")] == 29 and counts[("v", "r", "small")] == 1


def test_one_sided_selection(spark, classes):
    x, y, _ = classes
    y = np.array(y, dtype=object)
    df = frame(spark, x, y=y)
    stage = operator("UndersampleOSS")(n_neighbors=1)
    out = sorted(got(stage.fit_transform(Dataset(df, target="y")).df))
    from tabloom.functions.sampling import draw

    keys = {(r[0], r[1]): r[2] for r in df.select("x0", "x1", draw(["x0", "x1", "y"], 42)).collect()}
    keep = np.zeros(len(x), bool)
    for c in "abc":
        own = np.flatnonzero(y == c)
        seed = min(own, key=lambda i: keys[tuple(x[i])])
        for i in own:
            store = [*np.flatnonzero(y == "c"), seed]
            best = min(store, key=lambda j: ((x[i] - x[j]) ** 2).sum())
            keep[i] = c == "c" or i == seed or y[best] != c
    x2, y2 = x[keep], y[keep]
    d = ((x2[:, None] - x2[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    mate = d.argmin(1)
    gone = (mate[mate] == np.arange(len(x2))) & (y2 != y2[mate]) & (y2 != "c")
    assert out == sorted((*r, c) for r, c in zip(x2[~gone].tolist(), y2[~gone]))


def test_instance_hardness(spark, classes):
    x, y, kind = classes
    out = operator("UndersampleIHT")(trees=3, folds=2).fit_transform(Dataset(frame(spark, x, y=y, kind=kind), target="y")).df.toPandas()
    n = Counter(out["y"])
    assert n["c"] == 12 and 12 <= n["a"] <= 40 and 12 <= n["b"] <= 22
    kept, every = out[out["y"] == "a"][["x0", "x1"]].mean().abs().sum(), np.abs(x[:60].mean(0)).sum()
    assert kept < every + 0.8


def embedded(spark, name, x, **params):
    df = frame(spark, x, y=["p"] * len(x), i=np.arange(len(x)))
    columns = [f"x{j}" for j in range(x.shape[1])]
    out = operator(name)(columns, **params).fit_transform(Dataset(df, target="y")).df
    assert out.columns == ["y", "i", *[f"column_{j}" for j in range(len(out.columns) - 2)]]
    return out.orderBy("i").toPandas().iloc[:, 2:].to_numpy()


def test_kernel_components(spark):
    x = np.random.default_rng(4).normal(size=(80, 3)) @ np.diag([5, 2, 0.5])
    got_ = embedded(spark, "DimReduceKernelPCA", x)
    centred = x - x.mean(0)
    want = centred @ np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(got_), np.abs(want), atol=1e-8)
    k = manifold.kernel(x, x, "rbf")
    h = np.eye(80) - 1 / 80
    values, vectors = np.linalg.eigh(h @ k @ h)
    want = signed(vectors[:, ::-1][:, :2]) * np.sqrt(values[::-1][:2])
    assert np.allclose(embedded(spark, "DimReduceKernelPCA", x, kernel="rbf"), want, atol=1e-8)
    few = embedded(spark, "DimReduceKernelPCA", x, landmarks=40)  # rows that are no landmarks are placed too
    assert abs(np.corrcoef(few[:, 0], got_[:, 0])[0, 1]) > 0.99


def test_neighbourhood_embeddings_of_a_curve(spark):
    """A spiral unrolls: the first component follows the way along it."""
    t = np.linspace(1, 6, 120)
    x = np.stack([t * np.cos(2 * t), t * np.sin(2 * t), 0.01 * np.sin(9 * t)], 1)
    for name in ("DimReduceIsomap", "DimReduceLLE"):
        y = embedded(spark, name, x, n_neighbors=4)
        order = np.argsort(np.argsort(y[:, 0]))
        assert abs(np.corrcoef(order, np.arange(120))[0, 1]) > 0.99, name


def test_geodesic_of_two_parts():
    x = np.array([[0.0], [1.0], [2.0], [10.0], [11.5], [12.5]])
    want = np.abs(x - x.T)
    assert np.allclose(manifold.geodesic(x, 1), want)


def test_clusters_stay_apart(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.5, (40, 4)) for c in (0, 6, 12)])
    for name, params in (("DimReduceTSNE", {"steps": 150, "perplexity": 10}), ("DimReduceUMAP", {"steps": 80, "n_neighbors": 8})):
        y = embedded(spark, name, x, **params)
        centres = y.reshape(3, 40, 2).mean(1)
        own = ((y[:, None] - centres) ** 2).sum(2).argmin(1)
        assert (own == np.repeat(range(3), 40)).mean() > 0.95, name


def test_affinities_have_the_perplexity():
    d = manifold.distances(*[np.random.default_rng(6).normal(size=(50, 3))] * 2)
    p = manifold.affinities(d, 12.0)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(1)), 12, rtol=1e-3)
    a, b = manifold.curve(0.1)
    assert (a, b) == pytest.approx((1.577, 0.895), abs=0.02)


def test_metrics_by_loops():
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 3, (5, 4)).astype(float), rng.integers(0, 3, (6, 4)).astype(float)
    one = {
        "manhattan": lambda a, b: abs(a - b).sum(), "chebyshev": lambda a, b: abs(a - b).max(), "euclidean": lambda a, b: math.dist(a, b),
        "canberra": lambda a, b: sum(abs(p - q) / (abs(p) + abs(q)) for p, q in zip(a, b) if p or q), "hamming": lambda a, b: (a != b).mean(),
        "braycurtis": lambda a, b: abs(a - b).sum() / abs(a + b).sum(), "cosine": lambda a, b: 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)),
        "jaccard": lambda a, b: ((a != 0) ^ (b != 0)).sum() / ((a != 0) | (b != 0)).sum(), "dice": lambda a, b: ((a != 0) ^ (b != 0)).sum() / ((a != 0).sum() + (b != 0).sum()),
    }
    x[0], y[0] = 1, 2
    x[:, 0] += 1
    y[:, 0] += 1
    for name, f in one.items():
        assert np.allclose(manifold.METRICS[name](x, y), [[f(a, b) for b in y] for a in x]), name
    for name, f in manifold.METRICS.items():
        p = np.concatenate([x, y])[:, :2] if name == "haversine" else np.concatenate([x, y])
        assert np.isfinite(f(p, p)).all(), name


def test_nearest_by_another_measure():
    x = np.random.default_rng(8).normal(size=(30, 2))
    d, i = nearest(x, x, 3, measure=lambda p, q: manifold.METRICS["manhattan"](p, q) ** 2)
    want = np.sort(np.abs(x[:, None] - x[None]).sum(2), axis=1)[:, :3]
    assert np.allclose(d, want)
