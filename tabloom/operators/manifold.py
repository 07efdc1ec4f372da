"""Dimensionality reduction by kernels and by neighbourhoods.

These embeddings are defined by all pairs of rows. They are fitted on landmarks, a draw of at most `landmarks` rows (all
rows if there are no more, and then they are the textbook ones), and every row is placed by its relation to the
landmarks. A missing value is taken as the landmarks' mean of its column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabloom.core import Domain, Feature, Stage
from tabloom.functions.knn import matrix, references, vector
from tabloom.functions.sampling import bounded_sample
from tabloom.operators.basic import q
from tabloom.operators.features import signed


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


class _Embed(Stage):
    feature, needs_target = Feature.NUMERIC, Feature.ANY

    def learn(self, x: np.ndarray) -> tuple:
        """What place() needs of the landmarks x."""
        raise NotImplementedError

    @staticmethod
    def place(x: np.ndarray, learned: tuple) -> np.ndarray:
        raise NotImplementedError

    def _fit(self, df, columns):
        x, _, _ = references(bounded_sample(df, int(self.params["landmarks"]), columns), columns)
        mean = np.nan_to_num(np.nanmean(x, axis=0)) if len(x) else np.zeros(len(columns))
        self.mean, self.learned = mean, self.learn(np.where(np.isnan(x), mean, x))

    def _transform(self, df):
        sc, columns, place, k = df.sparkSession.sparkContext, self.columns, self.place, int(self.params["n_components"])
        given = sc.broadcast((self.mean, self.learned))

        @F.pandas_udf("array<double>")
        def embed(rows):
            import pandas as pd

            mean, learned = given.value
            x = matrix(rows, len(columns))
            x = np.where(np.isnan(x), mean, x)
            out = [place(x[i : i + 1024], learned) for i in range(0, len(x), 1024)]
            return pd.Series(list(np.concatenate(out)) if out else [])

        placed = df.withColumn("placed_", embed(vector(columns)))
        return placed.select(*[q(c) for c in df.columns if c not in columns], *[F.get("placed_", j).alias(f"column_{j}") for j in range(k)])


def _padded(y: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([y[:, :k], np.zeros((len(y), max(0, k - y.shape[1])))], 1)


def kernel(x: np.ndarray, y: np.ndarray, name: str) -> np.ndarray:
    gamma = 1 / x.shape[1]
    if name == "rbf":
        return np.exp(-gamma * distances(x, y) ** 2)
    if name == "cosine":
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
    dot = x @ y.T
    return {"linear": lambda: dot, "cosine": lambda: dot, "poly": lambda: (gamma * dot + 1) ** 3, "sigmoid": lambda: np.tanh(gamma * dot + 1)}[name]()


class DimReduceKernelPCA(_Embed):
    """Principal components in the kernel's space."""

    category = "reduction"
    domains = {"n_components": Domain(2, 1, 10000), "kernel": Domain("linear", choices=("linear", "poly", "rbf", "sigmoid", "cosine")), "landmarks": Domain(1000, 2, 5000)}

    def learn(self, x):
        name, k = self.params["kernel"], int(self.params["n_components"])
        full = kernel(x, x, name)
        columns, total = full.mean(0), full.mean()
        values, vectors = np.linalg.eigh(full - columns - columns[:, None] + total)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        vectors = signed(vectors) / np.sqrt(np.where(values > 1e-10 * max(values.max(initial=0), 1e-300), values, np.inf))
        return x, name, columns, total, vectors, k

    @staticmethod
    def place(x, learned):
        marks, name, columns, total, vectors, k = learned
        own = kernel(x, marks, name)
        return _padded((own - own.mean(1, keepdims=True) - columns + total) @ vectors, k)


def nearest_marks(d: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def geodesic(x: np.ndarray, k: int) -> np.ndarray:
    """Lengths of shortest paths over the graph of nearest neighbours; its parts are joined at their nearest rows."""
    d = distances(x, x)
    n = len(x)
    away = d + np.diag(np.full(n, np.inf))
    w = np.full((n, n), np.inf)
    near = nearest_marks(away, min(k, n - 1))
    np.put_along_axis(w, near, np.take_along_axis(d, near, 1), 1)
    w = np.minimum(w, w.T)
    part = np.arange(n)
    while True:  # parts by spreading the least number
        least = np.minimum(part, np.where(np.isfinite(w), part[None], n).min(1))
        if (least == part).all():
            if not part.any():
                break
            apart = np.where(part[:, None] != part[None], d, np.inf)
            i, j = np.unravel_index(np.argmin(apart), apart.shape)
            w[i, j] = w[j, i] = d[i, j]
        part = least if not (least == part).all() else np.arange(n)
    np.fill_diagonal(w, 0)
    for m in range(n):
        np.minimum(w, w[:, m, None] + w[m], out=w)
    return w


class DimReduceIsomap(_Embed):
    """Classical scaling of path lengths; a row's paths lead over its nearest landmarks."""

    category = "reduction"
    domains = {"n_components": Domain(2, 1, 10000), "n_neighbors": Domain(5, 1, 100), "landmarks": Domain(1000, 2, 3000)}

    def learn(self, x):
        k = int(self.params["n_components"])
        paths = geodesic(x, int(self.params["n_neighbors"]))
        g = -0.5 * paths**2
        columns, total = g.mean(0), g.mean()
        values, vectors = np.linalg.eigh(g - columns - columns[:, None] + total)
        values, vectors = values[::-1][:k], signed(vectors[:, ::-1][:, :k])
        scaled = vectors / np.sqrt(np.where(values > 1e-10 * max(values.max(initial=0), 1e-300), values, np.inf))
        return x, paths, columns, total, scaled, int(self.params["n_neighbors"]), k

    @staticmethod
    def place(x, learned):
        marks, paths, columns, total, vectors, near, k = learned
        d = distances(x, marks)
        first = nearest_marks(d, near)
        way = (np.take_along_axis(d, first, 1)[:, :, None] + paths[first]).min(1)
        own = -0.5 * way**2
        return _padded((own - own.mean(1, keepdims=True) - columns + total) @ vectors, k)


def barycentre(x: np.ndarray, near: np.ndarray, marks: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights that put each row together from its neighbours best."""
    z = marks[near] - x[:, None]
    gram = z @ z.transpose(0, 2, 1)
    trace = np.trace(gram, axis1=1, axis2=2)
    gram += np.eye(near.shape[1]) * np.where(trace > 0, ridge * trace, ridge)[:, None, None]
    w = np.linalg.solve(gram, np.ones((*near.shape, 1)))[..., 0]
    return w / w.sum(1, keepdims=True)


class DimReduceLLE(_Embed):
    """Locally linear embedding: rows keep the weights by which their neighbours put them together."""

    category = "reduction"
    domains = {"n_components": Domain(2, 1, 10000), "n_neighbors": Domain(5, 1, 100), "landmarks": Domain(1000, 2, 3000)}

    def learn(self, x):
        k, n = int(self.params["n_components"]), len(x)
        near = nearest_marks(distances(x, x) + np.diag(np.full(n, np.inf)), min(int(self.params["n_neighbors"]), n - 1))
        w = np.zeros((n, n))
        np.put_along_axis(w, near, barycentre(x, near, x), 1)
        m = np.eye(n) - w
        _, vectors = np.linalg.eigh(m.T @ m)
        return x, signed(vectors[:, 1 : 1 + k]), near.shape[1], k

    @staticmethod
    def place(x, learned):
        marks, y, near, k = learned
        d = distances(x, marks)
        first = nearest_marks(d, near)
        out = (barycentre(x, first, marks)[..., None] * y[first]).sum(1)
        same = np.take_along_axis(d, first[:, :1], 1)[:, 0] <= 1e-7 * (1 + np.linalg.norm(x, axis=1))  # a landmark itself
        out[same] = y[first[same, 0]]
        return _padded(out, k)


def _between(x: np.ndarray, learned: tuple) -> np.ndarray:
    """Means of the nearest landmarks' places, weighted by nearness; a landmark is at its own place."""
    marks, y, near, k = learned
    d = distances(x, marks)
    first = nearest_marks(d, min(near, len(marks)))
    own = np.take_along_axis(d, first, 1)
    w = np.where(own[:, :1] <= 1e-7 * (1 + np.linalg.norm(x, axis=1, keepdims=True)), np.arange(own.shape[1]) == 0, 1 / np.maximum(own, 1e-300))
    return _padded((w[..., None] * y[first]).sum(1) / w.sum(1, keepdims=True), k)


def affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of Gaussian weights whose entropy is that of `perplexity` equal neighbours, by bisection."""
    d = d**2 + np.diag(np.full(len(d), np.inf))
    d = d - d.min(1, keepdims=True)
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    beta = np.ones(len(d))
    for _ in range(64):
        p = np.exp(-d * beta[:, None])
        p /= p.sum(1, keepdims=True)
        entropy = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(1)
        over = entropy > np.log(perplexity)
        low, high = np.where(over, beta, low), np.where(over, high, beta)
        beta = np.where(np.isfinite(high), (low + high) / 2, beta * 2)
    return p


def start(x: np.ndarray, k: int, scale: float) -> np.ndarray:
    centred = x - x.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    y = _padded(centred @ signed(vectors[:, ::-1][:, :k]), k)
    return y / max(float(y.std()), 1e-300) * scale


class DimReduceTSNE(_Embed):
    """t-SNE of the landmarks by gradient descent; fitted anew on each frame it transforms, as it has no map."""

    category = "reduction"
    domains = {"n_components": Domain(2, 1, 4), "perplexity": Domain(30, 2, 200), "steps": Domain(500, 10, 5000), "landmarks": Domain(1000, 2, 3000)}

    def learn(self, x):
        n, k = len(x), int(self.params["n_components"])
        if n < 3:
            return x, start(x, k, 1.0) if n else np.zeros((0, k)), 1, k
        p = affinities(distances(x, x), min(float(self.params["perplexity"]), (n - 1) / 3))
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        y = start(x, k, 1e-4)
        speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 12 / 4, 50)
        early = min(250, int(self.params["steps"]) // 2)
        for step in range(int(self.params["steps"])):
            near = 1 / (1 + distances(y, y) ** 2)
            np.fill_diagonal(near, 0)
            pull = ((12 if step < early else 1) * p - np.maximum(near / near.sum(), 1e-12)) * near
            g = 4 * (pull.sum(1)[:, None] * y - pull @ y)
            gain = np.maximum(np.where(g * speed < 0, gain + 0.2, gain * 0.8), 0.01)
            speed = (0.5 if step < early else 0.8) * speed - rate * gain * g
            y = y + speed
        return x, y - y.mean(0), 5, k

    place = staticmethod(_between)

    def _transform(self, df):
        self._fit(df, self.columns)
        return super()._transform(df)


def _pairs(x: np.ndarray, y: np.ndarray):
    """Counts of both, first alone, second alone and neither being nonzero, of all pairs of rows."""
    a, b = (x != 0).astype(float), (y != 0).astype(float)
    tt = a @ b.T
    tf, ft = a.sum(1)[:, None] - tt, b.sum(1) - tt
    return tt, tf, ft, x.shape[1] - tt - tf - ft


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1), 0.0)


def _each(x, y, f):
    return sum(f(x[:, None, j], y[None, :, j]) for j in range(x.shape[1]))


def _cosine(x, y):
    return 1 - _over(x @ y.T, np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))


def _haversine(x, y):
    a = np.sin((x[:, None, 0] - y[None, :, 0]) / 2) ** 2 + np.cos(x[:, None, 0]) * np.cos(y[None, :, 0]) * np.sin((x[:, None, 1] - y[None, :, 1]) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


def _boolean(f):
    return lambda x, y: f(*_pairs(x, y))


METRICS = {
    "euclidean": distances,
    "manhattan": lambda x, y: _each(x, y, lambda a, b: np.abs(a - b)),
    "chebyshev": lambda x, y: np.max([np.abs(x[:, None, j] - y[None, :, j]) for j in range(x.shape[1])], axis=0),
    "minkowski": distances,
    "canberra": lambda x, y: _each(x, y, lambda a, b: _over(np.abs(a - b), np.abs(a) + np.abs(b))),
    "braycurtis": lambda x, y: _over(_each(x, y, lambda a, b: np.abs(a - b)), _each(x, y, lambda a, b: np.abs(a + b))),
    "mahalanobis": lambda x, y: (lambda r: distances(x @ r, y @ r))(np.linalg.cholesky(np.linalg.pinv(np.cov(y.T).reshape(y.shape[1], -1)) + 1e-12 * np.eye(y.shape[1]))),
    "wminkowski": distances,
    "seuclidean": lambda x, y: (lambda s: distances(x / s, y / s))(np.where(y.std(0, ddof=1) > 0, y.std(0, ddof=1), 1)),
    "cosine": _cosine,
    "correlation": lambda x, y: _cosine(x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)),
    "haversine": _haversine,
    "hamming": lambda x, y: _each(x, y, lambda a, b: (a != b).astype(float)) / x.shape[1],
    "jaccard": _boolean(lambda tt, tf, ft, ff: _over(tf + ft, tt + tf + ft)),
    "dice": _boolean(lambda tt, tf, ft, ff: _over(tf + ft, 2 * tt + tf + ft)),
    "russellrao": _boolean(lambda tt, tf, ft, ff: 1 - tt / (tt + tf + ft + ff)),
    "kulsinski": _boolean(lambda tt, tf, ft, ff: (2 * (tf + ft) + ff) / (tt + 2 * (tf + ft) + ff)),
    "rogerstanimoto": _boolean(lambda tt, tf, ft, ff: _over(2 * (tf + ft), tt + ff + 2 * (tf + ft))),
    "sokalmichener": _boolean(lambda tt, tf, ft, ff: _over(2 * (tf + ft), tt + ff + 2 * (tf + ft))),
    "sokalsneath": _boolean(lambda tt, tf, ft, ff: _over(tf + ft, 0.5 * tt + tf + ft)),
    "yule": _boolean(lambda tt, tf, ft, ff: _over(2 * tf * ft, tt * ff + tf * ft)),
}


def fuzzy(d: np.ndarray, k: int) -> np.ndarray:
    """Symmetric membership weights of the neighbour graph: 1 at the nearest row, falling off so that each row's
    weights add up to log2 k."""
    n = len(d)
    away = d + np.diag(np.full(n, np.inf))
    near = nearest_marks(away, min(k, n - 1))
    own = np.take_along_axis(d, near, 1)
    first = np.where(own > 0, own, np.inf).min(1)
    first = np.where(np.isfinite(first), first, 0)[:, None]
    gap = np.maximum(own - first, 0)
    low, high, sigma = np.zeros(n), np.full(n, np.inf), np.ones(n)
    goal = np.log2(max(k, 2))
    for _ in range(64):
        total = np.exp(-gap / sigma[:, None]).sum(1)
        over = total > goal
        low, high = np.where(over, low, sigma), np.where(over, sigma, high)
        sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
    sigma = np.maximum(sigma, 1e-3 * max(float(own.mean()), 1e-12))
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-gap / sigma[:, None]), 1)
    return w + w.T - w * w.T


def curve(min_dist: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a r^2b) nearest to a plateau up to min_dist with an exponential fall behind it, by Gauss-Newton."""
    r = np.linspace(0, 3, 300)[1:]
    goal = np.where(r < min_dist, 1.0, np.exp(-(r - min_dist)))
    a, b = 1.0, 1.0
    for _ in range(200):
        u = r ** (2 * b)
        f = 1 / (1 + a * u)
        j = np.stack([-u * f**2, -a * u * 2 * np.log(r) * f**2], 1)
        step = np.linalg.solve(j.T @ j + 1e-6 * np.eye(2), j.T @ (goal - f))
        a, b = max(a + 0.5 * step[0], 1e-3), max(b + 0.5 * step[1], 1e-3)
    return a, b


class DimReduceUMAP(_Embed):
    """Fuzzy neighbour graph of the landmarks laid out by stochastic gradient steps."""

    category = "reduction"
    domains = {
        "n_neighbors": Domain(5, 1, 100), "n_components": Domain(2, 1, 10000), "min_dist": Domain(0.1, 0.0, 0.99, whole=False),
        "metric": Domain("euclidean", choices=tuple(METRICS)), "steps": Domain(200, 10, 5000), "landmarks": Domain(1000, 2, 3000),
    }

    def learn(self, x):
        n, k, near = len(x), int(self.params["n_components"]), int(self.params["n_neighbors"])
        if n < 3:
            return x, start(x, k, 1.0) if n else np.zeros((0, k)), 1, k
        if self.params["metric"] == "haversine" and x.shape[1] != 2:
            raise ValueError("haversine takes two columns")
        w = fuzzy(METRICS[self.params["metric"]](x, x), near)
        (a, b), rng = curve(float(self.params["min_dist"])), np.random.default_rng(42)
        i, j = np.nonzero(w > w.max() / int(self.params["steps"]))
        due, y = w[i, j] / w.max(), start(x, k, 5.0) + rng.normal(0, 1e-4, (n, k))
        steps = int(self.params["steps"])
        for step in range(steps):
            rate, take = 1 - step / steps, rng.random(len(i)) < due
            move = np.zeros_like(y)
            s, t = i[take], j[take]
            gap = y[s] - y[t]
            r = np.maximum((gap**2).sum(1), 1e-12)[:, None]
            g = np.clip(-2 * a * b * r ** (b - 1) / (1 + a * r**b) * gap, -4, 4)
            np.add.at(move, s, g)
            np.add.at(move, t, -g)
            s, t = np.repeat(s, 5), rng.integers(0, n, 5 * len(s))
            gap = y[s] - y[t]
            r = (gap**2).sum(1)[:, None]
            g = np.clip(2 * b / ((0.001 + r) * (1 + a * r**b)) * gap, -4, 4)
            np.add.at(move, s[s != t], g[s != t])
            y = y + rate * np.clip(move, -4, 4)
        return x, y, min(near + 1, n), k

    place = staticmethod(_between)
