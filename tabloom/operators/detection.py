"""Outliers by isolation, by local density and by a one-class boundary.

Rows with a missing value in a selected column have no place among the others and are dropped, as by the bounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.core import Domain, Feature, Role, Stage
from tabloom.functions import clean
from tabloom.functions.knn import matrix, nearest_everywhere, references, vector
from tabloom.functions.sampling import bounded_sample, draw


class _Detect(Stage):
    """Keeps the rows that are not outliers of the frame itself."""

    role, changes_rows, feature = Role.TRAIN, True, Feature.NUMERIC

    def live(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(lambda a, b: a & b, [clean(c, df).isNotNull() for c in self.columns]))

    def sample(self, df: DataFrame, rows: int) -> np.ndarray:
        """At most about `rows` rows, all if there are no more."""
        return references(bounded_sample(df, rows, self.columns), self.columns)[0]


def path_norm(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    long = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An isolation tree as arrays over heap places: feature (-1 at a leaf), threshold, path length of a leaf."""
    depth = max(1, int(np.ceil(np.log2(max(2, len(x))))))
    feature, cut, length = np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1)), np.zeros(2 ** (depth + 1))
    todo = [(1, x, 0)]
    while todo:
        at, own, level = todo.pop()
        spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
        if level == depth or not len(spread):
            length[at] = level + path_norm(len(own))
            continue
        f = int(rng.choice(spread))
        low, high = own[:, f].min(), own[:, f].max()
        t = rng.uniform(low, high)
        left = own[:, f] <= t
        if left.all():  # the draw was the largest value
            t, left = low, own[:, f] <= low
        feature[at], cut[at] = f, t
        todo += [(2 * at, own[left], level + 1), (2 * at + 1, own[~left], level + 1)]
    return feature, cut, length


def isolation(x: np.ndarray, trees: list, size: int) -> np.ndarray:
    """Anomaly score of each row: near 1 where few cuts isolate it, 1/2 on average."""
    total = np.zeros(len(x))
    for feature, cut, length in trees:
        at = np.ones(len(x), np.int64)
        for _ in range(int(np.log2(len(feature)))):
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            at[inner] = 2 * at[inner] + (x[inner, f[inner]] > cut[at[inner]])
        total += length[at]
    return 2.0 ** (-total / max(1, len(trees)) / max(float(path_norm(size)), 1e-12))


class RemoveOutliersIsolationForest(_Detect):
    """Trees of random cuts over samples of the rows; rows of a score above one half go.

    The samples of all trees together are all that the driver sees.
    """

    category = "outliers"
    domains = {"trees": Domain(100, 1, 1000), "sample_rows": Domain(256, 2, 4096)}

    def _transform(self, df):
        live, columns = self.live(df), self.columns
        n, size = int(self.params["trees"]), int(self.params["sample_rows"])
        x, rng = self.sample(live, n * size), np.random.default_rng(42)
        if len(x) < 2:
            return live
        size = min(size, len(x))
        trees = live.sparkSession.sparkContext.broadcast([grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(n)])

        @F.pandas_udf("double")
        def score(rows):
            import pandas as pd

            return pd.Series(isolation(matrix(rows, len(columns)), trees.value, size))

        return live.where(score(vector(columns)) <= 0.5)


def outlier_factor(distance: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Local outlier factor of each row from its neighbours: their mean density by its own."""
    reach = np.maximum(distance[:, -1][index], distance)
    density = 1 / (reach.mean(1) + 1e-10)
    return density[index].mean(1) / density


class RemoveOutliersLocalOutlierFactor(_Detect):
    """Rows whose neighbours lie in places of much higher density go: factor above 1.5.

    Neighbours are exact; the driver holds all rows once and two neighbours of each.
    """

    category = "outliers"
    domains = {"n_neighbors": Domain(2, 1, 100), "cutoff": Domain(1.5, 1.0, 100.0, whole=False)}

    def _transform(self, df):
        live, columns, k = self.live(df), self.columns, int(self.params["n_neighbors"])
        x, _, keys = references(live, columns)
        if len(x) <= k:
            return live
        distance, index = nearest_everywhere(live.sparkSession.sparkContext, x, keys, x, keys, k, with_distance=True)
        far = keys[outlier_factor(distance, index) > self.params["cutoff"]]
        gone = live.sparkSession.createDataFrame([(int(v),) for v in np.unique(far)], "gone_ long")
        return live.join(gone, draw(columns, 42) == F.col("gone_"), "left_anti")


def one_class(k: np.ndarray, nu: float, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, offset) of the one-class dual: least a'ka with weights in 0 .. 1 / (nu n) that add up to 1, by moving
    weight between the two rows that violate the optimum most."""
    n = len(k)
    most = 1 / (nu * n)
    a = np.zeros(n)
    full = int(nu * n)
    a[:full] = most
    if full < n:
        a[full] = 1 - full * most
    gradient = k @ a
    for _ in range(200 * n):
        up, down = a < most - 1e-12, a > 1e-12
        i, j = int(np.argmin(np.where(up, gradient, np.inf))), int(np.argmax(np.where(down, gradient, -np.inf)))
        if gradient[j] - gradient[i] < tolerance:
            break
        step = min((gradient[j] - gradient[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), most - a[i], a[j])
        a[i], a[j] = a[i] + step, a[j] - step
        gradient += step * (k[:, i] - k[:, j])
    free = (a > 1e-10) & (a < most - 1e-10)
    return a, float(gradient[free].mean() if free.any() else (gradient[a > 1e-10].max() + gradient[a <= 1e-10].min(initial=np.inf)) / 2 if (a <= 1e-10).any() else gradient.max())


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


class RemoveOutliersOneClassSVM(_Detect):
    """Rows outside of the boundary around a share 1 - nu of the rows go (Gaussian kernel of width by variance).

    The boundary is fitted on at most sample_rows rows (all if there are no more); every row is judged by it.
    """

    category = "outliers"
    domains = {"nu": Domain(0.5, 0.001, 1.0, whole=False), "sample_rows": Domain(2000, 2, 10000)}

    def _transform(self, df):
        live, columns = self.live(df), self.columns
        x = self.sample(live, int(self.params["sample_rows"]))
        if len(x) < 2 or not x.var():
            return live
        gamma = 1 / (x.shape[1] * x.var())
        a, offset = one_class(gaussian(x, x, gamma), float(self.params["nu"]))
        given = live.sparkSession.sparkContext.broadcast((x[a > 1e-10], a[a > 1e-10]))

        @F.pandas_udf("double")
        def decision(rows):
            import pandas as pd

            y, (support, weight) = matrix(rows, len(columns)), given.value
            return pd.Series(np.concatenate([np.zeros(0), *[gaussian(y[i : i + 1024], support, gamma) @ weight for i in range(0, len(y), 1024)]]) - offset)

        return live.where(decision(vector(columns)) >= -1e-9)
