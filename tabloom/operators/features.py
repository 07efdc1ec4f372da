"""Feature selection and linear dimensionality reduction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.core import Domain, Feature, Stage
from tabloom.functions import average_ranks, clean, linear_quantiles, stats
from tabloom.functions.storage import shared_table
from tabloom.operators.basic import _KeepColumns, q


class DropInvariantColumns(_KeepColumns):
    category = "selection"

    def _fit(self, df, columns):
        got = stats(df, **{f"{i}{k}": f(q(c)) for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))})
        self.kept = [c for i, c in enumerate(columns) if got[f"{i}a"] is None or got[f"{i}a"] != got[f"{i}b"]]


class SelectVariationThreshold(Stage):
    category, feature = "selection", Feature.NUMERIC
    domains = {"coef_var_threshold": Domain(0.05, 0.01, 0.05, whole=False)}

    def _fit(self, df, columns):
        got = stats(df, **{f"{i}{k}": f(clean(c, df)) for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))})
        self.dropped = [c for i, c in enumerate(columns) if got[f"{i}m"] is not None and got[f"{i}s"] is not None and (got[f"{i}m"] == 0 and got[f"{i}s"] == 0 or got[f"{i}m"] != 0 and got[f"{i}s"] / got[f"{i}m"] < self.params["coef_var_threshold"])]

    def _transform(self, df):
        return df.drop(*self.dropped)


class _SelectBest(Stage):
    """Keeps the n_features columns of the largest score among the selected ones."""

    feature, min_features = Feature.NUMERIC, 2
    domains = {"n_features": Domain(2, 1, 10000)}

    def scores(self, df: DataFrame, columns: list[str]) -> dict[str, float]:
        raise NotImplementedError

    def _fit(self, df, columns):
        self.found = {c: float("nan") if s is None else float(s) for c, s in self.scores(df, columns).items()}
        ranked = sorted(columns, key=lambda c: (self.found[c] != self.found[c], -self.found[c] if self.found[c] == self.found[c] else 0, columns.index(c)))
        self.kept = ranked[: int(self.params["n_features"])]

    def _transform(self, df):
        return df.drop(*[c for c in self.columns if c not in self.kept])


class SelectUnivariatePearson(_SelectBest):
    category, needs_target = "selection", Feature.NUMERIC

    def scores(self, df, columns):
        y = clean(self.target, df)
        got = stats(df, **{str(i): F.corr(clean(c, df), y) for i, c in enumerate(columns)})
        return {c: got[str(i)] for i, c in enumerate(columns)}


class SelectUnivariateSpearman(_SelectBest):
    """Pearson's r of average ranks; ranks come from value counts joined back."""

    category, needs_target = "selection", Feature.NUMERIC

    def scores(self, df, columns):
        base = df.select(*[q(c).cast("double").alias(c) for c in [*columns, self.target]])
        for i, c in enumerate([*columns, self.target]):
            base = average_ranks(base, c, f"rank{i}_")
        got = stats(base, **{str(i): F.corr(f"rank{i}_", f"rank{len(columns)}_") for i in range(len(columns))})
        return {c: got[str(i)] for i, c in enumerate(columns)}


def _by_class(df: DataFrame, target: str, columns: list[str]):
    """Per class: rows, and count, sum and sum of squares of each column; one row per class."""
    xs = [clean(c, df) for c in columns]
    rows = df.groupBy(q(target).alias("class")).agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(xs) for k, f in (("c", F.count), ("s", F.sum), ("v", F.var_pop))]).collect()
    return [r.asDict() for r in rows if r["class"] is not None]


class SelectUnivariateANOVA(_SelectBest):
    category, needs_target = "selection", Feature.ANY

    def scores(self, df, columns):
        rows, out = _by_class(df, self.target, columns), {}
        for i, c in enumerate(columns):
            own = [(r[f"c{i}"], r[f"s{i}"] / r[f"c{i}"], r[f"v{i}"]) for r in rows if r[f"c{i}"]]
            n, g = sum(k for k, _, _ in own), len(own)
            mean = sum(k * m for k, m, _ in own) / n if n else 0
            between, within = sum(k * (m - mean) ** 2 for k, m, _ in own), sum(k * v for k, _, v in own)
            out[c] = (between / (g - 1)) / (within / (n - g)) if g > 1 and n > g and within > 0 else float("nan")
        return out


class SelectUnivariateChi2(_SelectBest):
    category, needs_target = "selection", Feature.CATEGORICAL

    def scores(self, df, columns):
        rows, out = _by_class(df, self.target, columns), {}
        n = sum(r["n"] for r in rows)
        for i, c in enumerate(columns):
            total = sum(r[f"s{i}"] or 0 for r in rows)
            out[c] = sum(((r[f"s{i}"] or 0) - r["n"] / n * total) ** 2 / (r["n"] / n * total) for r in rows) if total else float("nan")
        return out


def discordant(y: np.ndarray, w: np.ndarray) -> int:
    """Weight of the pairs in which an earlier row has the larger y; by the highest bit in which ranks differ."""
    rank = np.unique(y, return_inverse=True)[1]
    total, order = 0, np.arange(len(rank))
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one, group = rank[order] >> bit & 1, rank[order] >> (bit + 1)
        own = w[order]
        ones = np.cumsum(own * one)
        first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        base = np.repeat((ones - own * one)[first], np.diff(first, append=len(group)))
        total += int(((ones - base) * own * (1 - one)).sum())
        order = order[np.argsort(rank[order] >> bit, kind="stable")]
    return total


class SelectUnivariateKendall(_SelectBest):
    """Kendall's tau-b, exact. Pairs of values are counted, dealt by ranges of x and by ranges of y: pairs of rows of
    different ranges both ways are settled by the table of counts of both ranges, those of one range of x by the task
    that has it, and those of one range of y but not of x by the task that has that one. Ranges have about `range_rows`
    pairs of values; a value on which ranges meet is a range of its own, which has only ties and is not looked at."""

    category, needs_target = "selection", Feature.NUMERIC
    range_rows = 200_000
    most_ranges = 1024

    def scores(self, df, columns):
        return {c: self.tau(df, c) for c in columns}

    def tau(self, df, c):
        xy = df.select(clean(c, df).alias("x"), clean(self.target, df).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        cells = shared_table(xy.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")), "pairs")
        n, rows = cells.agg(F.sum("w"), F.count(F.lit(1))).first()
        if not rows or n < 2:
            return float("nan")
        ties = [cells.groupBy(*by).agg(F.sum("w").alias("w")).agg(F.sum(F.col("w").cast("double") * (F.col("w") - 1) / 2)).first()[0] for by in (["x"], ["y"], ["x", "y"])]
        k = max(2, min(self.most_ranges, -(-rows // self.range_rows)))
        cuts = {a: sorted(set(cells.approxQuantile(a, [i / k for i in range(1, k)], 0.2 / k))) for a in "xy"}


        def at(a: str) -> Column:
            marks = F.array(*map(F.lit, cuts[a]))
            return 2 * F.size(F.filter(marks, lambda m: m < F.col(a))) + F.array_contains(marks, F.col(a)).cast("int") if cuts[a] else F.lit(0)

        dealt = shared_table(cells.withColumns({f"b{a}": at(a) for a in "xy"}), "dealt")
        t = np.zeros((2 * k + 1, 2 * k + 1))
        for a, b, w in dealt.groupBy("bx", "by").agg(F.sum("w")).collect():  # at most ranges squared
            t[a, b] = w
        right = t[:, ::-1].cumsum(1)[:, ::-1]
        before = right.cumsum(0)
        apart = sum(float((t[i, :-1] * before[i - 1, 1:]).sum()) for i in range(1, len(t)))  # earlier range of x, later one of y
        same_x = dealt.where("bx % 2 = 0").groupBy("bx").applyInPandas(lambda f: _settle(f, None), "d long").agg(F.sum("d")).first()[0] or 0
        same_y = dealt.where("by % 2 = 0").groupBy("by").applyInPandas(lambda f: _settle(f, "bx"), "d long").agg(F.sum("d")).first()[0] or 0
        pairs, against = n * (n - 1) / 2, apart + same_x + same_y
        left, other = pairs - ties[0], pairs - ties[1]
        concordant = pairs - ties[0] - ties[1] + ties[2] - against
        return (concordant - against) / (left * other) ** 0.5 if left > 0 and other > 0 else float("nan")


def _settle(frame, apart: str | None):
    """Discordant weight among the rows of a frame; of rows with different `apart` only, if it is given."""
    import pandas as pd

    frame = frame.sort_values(["x", "y"])
    y, w = frame["y"].to_numpy(), frame["w"].to_numpy()
    total = discordant(y, w)
    if apart:
        for _, part in frame.groupby(apart):
            total -= discordant(part["y"].to_numpy(), part["w"].to_numpy())
    return pd.DataFrame({"d": [total]})


class _MutualInformation(_SelectBest):
    """Mutual information on a grid of equal-count classes, whose counts are all the driver sees."""

    cells = 32
    classes = False

    def scores(self, df, columns):
        names = columns if self.classes else [*columns, self.target]
        cuts = linear_quantiles(df, names, [k / self.cells for k in range(1, self.cells)])

        def cell(i: int) -> Column:
            marks = sorted(set(cuts[names[i]]))
            return F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < clean(names[i], df))) if marks else F.lit(0)

        y = q(self.target) if self.classes else cell(len(columns))
        binned = df.where(q(self.target).isNotNull()).select(y.alias("y"), *[cell(i).alias(f"b{i}") for i in range(len(columns))])
        out = {}
        for i, c in enumerate(columns):
            rows = binned.groupBy(f"b{i}", "y").count().collect()
            n = sum(r[2] for r in rows)
            px, py = {}, {}
            for a, b, k in rows:
                px[a], py[b] = px.get(a, 0) + k, py.get(b, 0) + k
            out[c] = sum(k / n * np.log(k * n / (px[a] * py[b])) for a, b, k in rows) if n else float("nan")
        return out


class SelectUnivariateMutualInformationReg(_MutualInformation):
    category, needs_target = "selection", Feature.NUMERIC


class SelectUnivariateMutualInformationCls(_MutualInformation):
    category, needs_target, classes = "selection", Feature.CATEGORICAL, True


class _Eliminate(_SelectBest):
    """Recursive elimination by a tree's importances, one feature at a time."""

    learner = ""

    def scores(self, df, columns):
        from pyspark.ml.feature import StringIndexer, VectorAssembler
        from pyspark.ml import classification, regression

        base = df.select(*[clean(c, df).alias(c) for c in columns], q(self.target).alias("label_")).na.drop()
        if self.learner == "DecisionTreeClassifier":
            base = StringIndexer(inputCol="label_", outputCol="label").fit(base).transform(base)
        else:
            base = base.withColumn("label", F.col("label_").cast("double"))
        module = classification if self.learner == "DecisionTreeClassifier" else regression
        left, out = list(columns), {}
        base = base.persist()
        try:
            while len(left) > int(self.params["n_features"]):
                vectors = VectorAssembler(inputCols=left, outputCol="features").transform(base)
                weight = getattr(module, self.learner)(seed=7).fit(vectors).featureImportances.toArray()
                worst = left[int(np.argmin(weight))]
                out[worst] = float(len(columns) - len(left)) - len(columns)
                left.remove(worst)
        finally:
            base.unpersist()
        return {**{c: 1.0 for c in left}, **out}


class SelectRFEDecisionTreeReg(_Eliminate):
    category, needs_target, learner = "selection", Feature.NUMERIC, "DecisionTreeRegressor"


class SelectRFEDecisionTreeCls(_Eliminate):
    category, needs_target, learner = "selection", Feature.CATEGORICAL, "DecisionTreeClassifier"


def moments(df: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means, and the matrix of products about the mean, from one pass; rows with a null count in no moment."""
    xs = [clean(c, df) for c in columns]
    whole = df.where(sum((x.isNull().cast("int") for x in xs), F.lit(0)) == 0)
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    got = whole.agg(F.count(F.lit(1)), *[F.avg(x) for x in xs], *[F.covar_pop(xs[i], xs[j]) for i, j in pairs]).first()
    n, mean, m = got[0], np.array([v or 0.0 for v in got[1 : 1 + len(xs)]]), np.zeros((len(xs), len(xs)))
    for (i, j), v in zip(pairs, got[1 + len(xs) :]):
        m[i, j] = m[j, i] = (v or 0.0) * n
    return n, mean, m


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest loading is positive."""
    if not vectors.size:
        return vectors
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


class _Project(Stage):
    """Selected columns to column_0, column_1, ... by a matrix applied as a column expression."""

    feature = Feature.NUMERIC
    domains = {"n_components": Domain(2, 1, 10000)}

    def _transform(self, df):
        xs = [clean(c, df) - F.lit(float(m)) for c, m in zip(self.columns, self.centre)]
        new = [sum((x * float(w) for x, w in zip(xs, axis)), F.lit(0.0)).alias(f"column_{j}") for j, axis in enumerate(self.axes.T)]
        return df.select(*[q(c) for c in df.columns if c not in self.columns], *new)


class DimReducePCA(_Project):
    category, needs_target = "reduction", Feature.ANY

    def _fit(self, df, columns):
        n, self.centre, m = moments(df, columns)
        values, vectors = np.linalg.eigh(m)
        k = min(int(self.params["n_components"]), len(columns))
        self.axes, self.variances = signed(vectors[:, ::-1][:, :k]), values[::-1][:k] / max(1, n - 1)


class DimReduceTruncatedSVD(_Project):
    category = "reduction"

    def _fit(self, df, columns):
        n, mean, m = moments(df, columns)
        values, vectors = np.linalg.eigh(m + n * np.outer(mean, mean))
        k = min(int(self.params["n_components"]), len(columns))
        self.centre, self.axes, self.singular = np.zeros(len(columns)), signed(vectors[:, ::-1][:, :k]), np.sqrt(np.maximum(values[::-1][:k], 0))


class DimReduceLDA(_Project):
    category, needs_target = "reduction", Feature.CATEGORICAL

    def _fit(self, df, columns):
        n, self.centre, m = moments(df, columns)
        rows = [r for r in _by_class(df, self.target, columns)]
        between = np.zeros_like(m)
        for r in rows:
            gap = np.array([(r[f"s{i}"] or 0) / max(1, r[f"c{i}"]) for i in range(len(columns))]) - self.centre
            between += r["n"] * np.outer(gap, gap)
        values, vectors = np.linalg.eig(np.linalg.pinv(m - between) @ between)
        k = min(int(self.params["n_components"]), len(rows) - 1, len(columns))
        self.axes = signed(np.real(vectors[:, np.argsort(-np.real(values))[:k]]))
