"""Outliers, scaling and generated features."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.core import TEMPORALS, Domain, Feature, Role, Stage
from tabloom.functions import clean, linear_quantiles, nearest_quantiles, safe_div, stats, upper_break
from tabloom.operators.basic import _Each, q


class _Bounds(Stage):
    """Keeps rows with every selected value within bounds of the frame itself; a null is outside."""

    role, changes_rows, feature = Role.TRAIN, True, Feature.NUMERIC

    def bounds(self, df):
        raise NotImplementedError

    def _transform(self, df):
        limits = {c: b for c, b in self.bounds(df).items()}
        return df.where(reduce(lambda a, b: a & b, [q(c).between(*b) if None not in b else F.lit(False) for c, b in limits.items()]))


class RemoveOutliersSTD(_Bounds):
    category = "outliers"
    domains = {"cutoff_coef": Domain(3, 2, 5, whole=False)}

    def bounds(self, df):
        got = stats(df, **{f"{i}{k}": f(clean(c, df)) for i, c in enumerate(self.columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))})
        k = self.params["cutoff_coef"]
        return {c: (None, None) if got[f"{i}s"] is None else (got[f"{i}m"] - k * got[f"{i}s"], got[f"{i}m"] + k * got[f"{i}s"]) for i, c in enumerate(self.columns)}


class RemoveOutliersIQR(_Bounds):
    category = "outliers"
    domains = {"cutoff_coef": Domain(2, 2, 5, whole=False)}

    def bounds(self, df):
        k = self.params["cutoff_coef"]
        found = nearest_quantiles(df, self.columns, [0.25, 0.75])
        return {c: (None, None) if a is None else (a - k * (b - a), b + k * (b - a)) for c, (a, b) in found.items()}


class RemoveOutliersEllipticEnvelope(Stage):
    """Drops the tenth of rows that lie farthest by Mahalanobis distance from a trimmed centre.

    Centre and covariance come from sums of products in one pass, refined by steps that keep the nearer half.
    """

    category, role, changes_rows, feature = "outliers", Role.TRAIN, True, Feature.NUMERIC
    domains = {"contamination": Domain(0.1, 0.0, 0.5, whole=False), "steps": Domain(3, 0, 20)}

    def _transform(self, df):
        xs = [clean(c, df) for c in self.columns]
        d = len(xs)
        live = df.where(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs]))

        def moments(part):
            got = part.agg(F.count(F.lit(1)), *[F.avg(x) for x in xs], *[F.covar_samp(xs[i], xs[j]) for i in range(d) for j in range(i, d)]).first()
            cov, at = np.zeros((d, d)), 1 + d
            for i in range(d):
                for j in range(i, d):
                    cov[i, j] = cov[j, i] = got[at] or 0.0
                    at += 1
            return np.array([v or 0.0 for v in got[1 : 1 + d]]), np.linalg.pinv(cov)

        def distance(mean, inverse):
            gap = [x - float(m) for x, m in zip(xs, mean)]
            return sum(gap[i] * gap[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(d) for j in range(i, d))

        far = distance(*moments(live))
        for _ in range(int(self.params["steps"])):
            half = linear_quantiles(live.select(far.alias("m")), ["m"], [0.5])["m"]
            if not half:
                break
            far = distance(*moments(live.where(far <= half[0])))
        cut = linear_quantiles(live.select(far.alias("m")), ["m"], [1 - self.params["contamination"]])["m"]
        return live.where(far <= cut[0]) if cut else live


class _Scale(_Each):
    """x to (x - shift) / scale; a zero scale gives NaN or infinities."""

    feature, with_target = Feature.NUMERIC, False

    def expr(self, c, kind):
        a, b = self.numbers[c]
        return safe_div(q(c).cast("double") - F.lit(a).cast("double"), F.lit(b).cast("double"))

    def _inverse(self, df):
        return df.withColumns({c: q(c) * F.lit(b).cast("double") + F.lit(a).cast("double") for c, (a, b) in self.numbers.items() if c in df.columns})


class Normalize(_Scale):
    category = "scaling"

    def _fit(self, df, columns):
        got = stats(df, **{f"{i}{k}": f(clean(c, df)) for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))})
        self.numbers = {c: (got[f"{i}a"], None if got[f"{i}a"] is None else got[f"{i}b"] - got[f"{i}a"]) for i, c in enumerate(columns)}


class Standardize(_Scale):
    category = "scaling"

    def _fit(self, df, columns):
        got = stats(df, **{f"{i}{k}": f(clean(c, df)) for i, c in enumerate(columns) for k, f in (("a", F.avg), ("b", F.stddev_samp))})
        self.numbers = {c: (got[f"{i}a"], got[f"{i}b"]) for i, c in enumerate(columns)}


class ScaleRobust(_Scale):
    category = "scaling"

    def _fit(self, df, columns):
        mid, quarters = linear_quantiles(df, columns, [0.5]), nearest_quantiles(df, columns, [0.25, 0.75])
        self.numbers = {c: (None, None) if quarters[c][0] is None else (mid[c][0], quarters[c][1] - quarters[c][0]) for c in columns}


class QuantileTransform(_Each):
    """Values to their place in the fitted distribution, between landmarks by interpolation; ties to their middle."""

    category, feature, with_target = "scaling", Feature.NUMERIC, False
    domains = {"n_quantiles": Domain(1000, 10, 10000), "output_distribution": Domain("uniform", choices=("uniform", "normal"))}

    def _fit(self, df, columns):
        rows = stats(df, n=F.count(F.lit(1)))["n"]
        n = max(2, min(int(self.params["n_quantiles"]), rows))
        self.landmarks = linear_quantiles(df, columns, [i / (n - 1) for i in range(n)])

    def expr(self, c, kind):
        marks = self.landmarks[c]
        if not marks:
            return F.lit(None).cast("double")
        uniform = self.params["output_distribution"] == "uniform"

        @F.pandas_udf("double")
        def place(x):
            import pandas as pd

            m, at = np.array(marks), np.linspace(0, 1, len(marks))
            v = x.to_numpy(dtype=float, na_value=np.nan)
            ok = ~np.isnan(v)
            out = np.full(len(v), np.nan)
            out[ok] = 0.5 * (np.interp(v[ok], m, at) - np.interp(-v[ok], -m[::-1], -at[::-1]))
            if not uniform:
                from statistics import NormalDist

                out[ok] = [NormalDist().inv_cdf(p) for p in np.clip(out[ok], 1e-7, 1 - 1e-7)]
            return pd.Series(out).where(ok, None).astype("Float64")

        return place(q(c).cast("double"))

    def _inverse(self, df):
        new = {}
        for c, marks in self.landmarks.items():
            uniform = self.params["output_distribution"] == "uniform"

            @F.pandas_udf("double")
            def back(x, marks=marks, uniform=uniform):
                import pandas as pd
                from statistics import NormalDist

                v = x.to_numpy(dtype=float, na_value=np.nan)
                p = v if uniform else np.array([np.nan if np.isnan(z) else NormalDist().cdf(z) for z in v])
                return pd.Series(np.interp(p, np.linspace(0, 1, len(marks)), np.array(marks)))

            new[c] = back(q(c))
        return df.withColumns(new)


class TemporalExpand(Stage):
    category, kinds = "generation", TEMPORALS

    def _transform(self, df):
        new = {}
        for c in self.columns:
            kind, x = df.schema[c].dataType, q(c)
            if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                new |= {f"{c}_year": F.year(x), f"{c}_month": F.month(x), f"{c}_day": F.dayofmonth(x), f"{c}_weekday": F.weekday(x) + 1, f"{c}_ordinal_day": F.dayofyear(x)}
            if type(kind).__name__ == "TimeType":
                new |= {f"{c}_hour": F.hour(x), f"{c}_minute": F.minute(x), f"{c}_second": F.second(x), f"{c}_millisecond": F.pmod(F.floor(F.extract(F.lit("SECOND"), x) * 1000), F.lit(1000)).cast("int")}
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                new |= {f"{c}_hour": F.hour(x), f"{c}_minute": F.minute(x), f"{c}_second": F.second(x), f"{c}_millisecond": F.pmod(F.unix_millis(x.cast("timestamp")), F.lit(1000)).cast("int")}
        return df.withColumns(new)


class _Discretize(Stage):
    """A column of the upper break of each value's right-closed bin; the last bin's is infinity."""

    feature, suffix = Feature.NUMERIC, ""
    domains = {"bin_count": Domain(10, 2, 100)}

    def _transform(self, df):
        return df.withColumns({f"{c}_{self.suffix}": upper_break(clean(c, df), self.breaks[c]) for c in self.columns})


class DiscretizeUniform(_Discretize):
    category, suffix = "generation", "discrete"

    def _fit(self, df, columns):
        n = int(self.params["bin_count"])
        got = stats(df, **{f"{i}{k}": f(clean(c, df)) for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))})
        self.breaks = {c: [] if got[f"{i}a"] is None else [got[f"{i}a"] + (got[f"{i}b"] - got[f"{i}a"]) * k / (n - 1) for k in range(n)] for i, c in enumerate(columns)}


class DiscretizeQuantile(_Discretize):
    category, suffix = "generation", "quantile"

    def _fit(self, df, columns):
        n = int(self.params["bin_count"])
        self.breaks = {c: sorted(set(own)) for c, own in linear_quantiles(df, columns, [k / n for k in range(1, n)]).items()}


class DiscretizeKMeans(_Discretize):
    """Breaks: least value, midpoints of one-dimensional k-means centres, largest value. The steps run on value
    counts in bins of the range, which bound what the driver sees."""

    category, suffix = "generation", "kmeans"
    bins = 4096

    def _fit(self, df, columns):
        got = stats(df, **{f"{i}{k}": f(clean(c, df)) for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))})
        self.breaks = {}
        for i, c in enumerate(columns):
            a, b = got[f"{i}a"], got[f"{i}b"]
            if a is None or a == b:
                self.breaks[c] = [] if a is None else [a]
                continue
            x = clean(c, df)
            cell = F.least(F.floor((x - a) / ((b - a) / self.bins)), F.lit(self.bins - 1))
            rows = df.where(x.isNotNull()).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s")).orderBy("cell").collect()
            n, s = np.array([r["n"] for r in rows], float), np.array([r["s"] for r in rows])
            k = min(int(self.params["bin_count"]), len(rows))
            edges = np.linspace(a, b, k + 1)
            centres = (edges[1:] + edges[:-1]) / 2
            for _ in range(300):
                own = np.searchsorted((centres[1:] + centres[:-1]) / 2, s / n)
                weight = np.bincount(own, n, k)
                new = np.where(weight > 0, np.bincount(own, s, k) / np.maximum(weight, 1), centres)
                if np.allclose(new, centres, rtol=0, atol=1e-12 * (b - a)):
                    break
                centres = np.sort(new)
            self.breaks[c] = [float(a), *((centres[1:] + centres[:-1]) / 2).tolist(), float(b)]


class _Generate(Stage):
    feature, suffix = Feature.NUMERIC, ""

    def _transform(self, df):
        return df.withColumns({f"{c}_{self.suffix}": self.expr(q(c).cast("double")) for c in self.columns})


class TransformSquare(_Generate):
    category, suffix = "generation", "square"

    def expr(self, x):
        return x * x


class TransformRoot(_Generate):
    category, suffix = "generation", "root"

    def expr(self, x):
        return F.sqrt(x)


class TransformLog(_Generate):
    category, suffix = "generation", "log"

    def expr(self, x):
        return F.when(x == -1, F.lit(float("-inf"))).when(x < -1, F.lit(float("nan"))).otherwise(F.log1p(x))


class TransformExp(_Generate):
    category, suffix = "generation", "exp"

    def expr(self, x):
        return F.exp(x)
