"""Class balance: over- and undersampling; and imputation by neighbours."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.core import Domain, Feature, Role, Stage
from tabloom.functions import clean, stats
from tabloom.functions.knn import LIMIT, Blocks, matrix, nearest, nearest_everywhere, references, vector
from tabloom.functions.sampling import _ranked, draw, folds
from tabloom.functions.storage import shared_table
from tabloom.operators.basic import FillNoneMean, _Each, q


class FillNoneKNN(_Each):
    """A missing value becomes the mean of the column over the nearest fitted rows that have it."""

    category, feature, with_target = "missing", Feature.NUMERIC, False
    domains = {"n_neighbors": Domain(5, 1, 100)}

    def _fit(self, df, columns):
        self.refs, _, _ = references(df, columns)
        got = stats(df, **{str(i): F.avg(clean(c, df)) for i, c in enumerate(columns)})
        self.means = [got[str(i)] for i in range(len(columns))]

    def _transform(self, df):
        refs, columns, k, means = Blocks(df.sparkSession.sparkContext, self.refs), self.columns, int(self.params["n_neighbors"]), self.means

        @F.pandas_udf("array<double>")
        def fill(rows):
            import pandas as pd

            x = matrix(rows, len(columns))
            for j in range(len(columns)):
                gaps = np.flatnonzero(np.isnan(x[:, j]))
                if len(gaps) and len(refs):
                    d, index = nearest(x[gaps], refs, k, having=j)
                    near = np.isfinite(d)
                    sums = np.where(near, refs.take(index)[..., j], 0).sum(1)
                    x[gaps, j] = np.where(near.any(1), sums / np.maximum(near.sum(1), 1), np.nan if means[j] is None else means[j])
            return pd.Series(list(x))

        filled = df.withColumn("filled_", fill(vector(columns)))
        return filled.withColumns({c: F.when(clean(c, df).isNull(), F.when(~F.isnan(F.col("filled_")[j]), F.col("filled_")[j])).otherwise(q(c).cast("double")) for j, c in enumerate(columns)}).drop("filled_")


class FillNoneKNNOrMean(Stage):
    category, feature = "missing", Feature.NUMERIC
    domains = {"n_neighbors": Domain(5, 1, 100), "max_rows": Domain(LIMIT, 1, 10**9), "max_columns": Domain(100, 1, 10**6)}

    def _fit(self, df, columns):
        small = len(columns) <= self.params["max_columns"] and df.count() <= self.params["max_rows"]
        self.inner = FillNoneKNN(columns, n_neighbors=self.params["n_neighbors"]) if small else FillNoneMean(columns)
        self.inner.columns, self.inner.target = columns, self.target
        self.inner._fit(df, columns)

    def _transform(self, df):
        return self.inner._transform(df)


class _Resample(Stage):
    role, changes_rows, whole_frame, needs_target = Role.TRAIN, True, True, Feature.CATEGORICAL

    def counts(self, df: DataFrame) -> dict:
        return {r[0]: r[1] for r in df.where(q(self.target).isNotNull()).groupBy(q(self.target)).count().collect()}

    def ranked(self, df: DataFrame) -> DataFrame:
        return _ranked(df, [self.target], df.columns, 42)

    def numbers(self, df: DataFrame) -> list[str]:
        return [f.name for f in df.schema if f.name != self.target and Feature.NUMERIC.covers(Feature.of(f.dataType))]


class OversampleRandom(_Resample):
    """Each class up to ratio times the largest, by repeating its rows in draw order, round after round."""

    category = "oversampling"
    domains = {"ratio_to_majority": Domain(0.5, 0, 1, whole=False)}

    def _transform(self, df):
        n = self.counts(df)
        if not n:
            return df
        want = math.ceil(max(n.values()) * self.params["ratio_to_majority"])
        need = {c: want - k for c, k in n.items() if k < want}
        times = F.lit(0)
        for c, more in need.items():
            times = F.when(q(self.target) == F.lit(c), F.lit(more // n[c]) + (F.col("place_") <= more % n[c]).cast("int")).otherwise(times)
        return self.ranked(df).withColumn("copy_", F.explode(F.array_repeat(F.lit(0), 1 + times))).select(*[q(c) for c in df.columns])


class UndersampleRandom(_Resample):
    """At most ratio times the smallest class of each; rows of a null class stay."""

    category = "undersampling"
    domains = {"ratio_to_minority": Domain(2, 1, 2, whole=False)}

    def _transform(self, df):
        n = self.counts(df)
        if not n:
            return df
        cap = math.ceil(min(n.values()) * self.params["ratio_to_minority"])
        return self.ranked(df).where((F.col("place_") <= cap) | q(self.target).isNull()).select(*[q(c) for c in df.columns])


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number of 0 .. 1 for each id, whatever task it is drawn in."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2654435761 + 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


class _Synthetic(_Resample):
    """Rows made from a row and its nearest rows of its class, for classes short of the largest: numbers lie between
    the row and one of them, other values are the most frequent of theirs (of several the least).

    The driver holds all rows once, as neighbours do; new rows are made by the executors.
    """

    domains = {"n_neighbors": Domain(5, 2, 100)}
    by_difficulty = with_names = False

    def names(self, df: DataFrame) -> list[str]:
        return [f.name for f in df.schema if f.name != self.target and Feature.of(f.dataType) is Feature.CATEGORICAL] if self.with_names else []

    def space(self, x: np.ndarray, codes: np.ndarray, labels: np.ndarray, smallest) -> tuple[np.ndarray, object]:
        """The rows as points, and how far they are apart if not by Euclid."""
        return x, None

    def _transform(self, df):
        n, columns, names = self.counts(df), self.numbers(df), self.names(df)
        if not n or not [*columns, *names]:
            return df
        most, sc, k_ = max(n.values()), df.sparkSession.sparkContext, int(self.params["n_neighbors"]) - 1  # without the row itself
        smallest = min(n, key=lambda c: (n[c], str(c)))
        x, carried, keys = references(df.where(q(self.target).isNotNull()), columns, [self.target, *names])
        labels = np.array([r[0] for r in carried], dtype=object)
        values = [sorted({r[i + 1] for r in carried}, key=lambda v: (v is None, v)) for i in range(len(names))]
        place = [{v: j for j, v in enumerate(own)} for own in values]
        codes = np.array([[p[v] for p, v in zip(place, r[1:])] for r in carried], np.int64).reshape(len(carried), len(names))
        points, measure = self.space(x, codes, labels, smallest)
        kinds = {f.name: f.dataType for f in df.schema}
        schema = ", ".join([*(f"`{c}` double" for c in columns), *(f"`{c}` string" for c in names), f"`{self.target}` string"])
        for c, k in sorted(n.items(), key=lambda v: str(v[0])):
            rows = np.flatnonzero(labels == c)
            if k == most or len(rows) < 2:
                continue
            near = nearest_everywhere(sc, points[rows], keys[rows], points[rows], keys[rows], k_, measure=measure)
            upto = None
            if self.by_difficulty:
                other = (labels[nearest_everywhere(sc, points[rows], keys[rows], points, keys, k_, measure=measure)] != c).mean(1)
                if other.sum() == 0:
                    continue
                times = np.round(other / other.sum() * (most - k)).astype(int)
                if not times.any():  # every share rounds to nothing: one point each for the largest
                    times[np.argsort(-other, kind="stable")[: most - k]] = 1
                upto = sc.broadcast(np.cumsum(times))
            more = int(times.sum()) if self.by_difficulty else most - k
            known = Blocks(sc, np.concatenate([x[rows], codes[rows], near], 1))
            made = _made(columns, names, values, self.target, c, known, upto, near.shape[1])
            new = df.sparkSession.range(more).mapInPandas(made, schema)
            df = df.unionByName(new.select(*[q(a) if a in columns else q(a).cast(kinds[a]) for a in kinds if a in columns or a in names or a == self.target]), allowMissingColumns=True)
        return df


def _made(columns, names, values, target, label, known: Blocks, upto, neighbours: int):
    """New rows for ids: known has the rows of the class as numbers, codes and places of neighbours."""
    d, m = len(columns), len(names)

    def make(frames):
        import pandas as pd

        for frame in frames:
            ids = frame["id"].to_numpy()
            base = np.searchsorted(upto.value, ids, "right") if upto is not None else (uniform(ids, 1) * len(known)).astype(np.int64)
            own = known.take(base)
            near = own[:, d + m :].astype(np.int64)
            mate = near[np.arange(len(ids)), (uniform(ids, 2) * neighbours).astype(np.int64)]
            other = known.take(mate) if d else own
            out = pd.DataFrame(own[:, :d] + uniform(ids, 3)[:, None] * (other[:, :d] - own[:, :d]), columns=columns)
            votes = known.take(near)[:, :, d : d + m].astype(np.int64) if m else None
            for j, name in enumerate(names):
                counts = np.stack([(votes[:, :, j] == v).sum(1) for v in range(len(values[j]))], 1)
                out[name] = [values[j][v] for v in counts.argmax(1)]
            yield out.assign(**{target: str(label)})

    return make


class OversampleSMOTE(_Synthetic):
    category = "oversampling"


class OversampleADASYN(_Synthetic):
    """More points where more of a row's neighbours are of other classes."""

    category, by_difficulty = "oversampling", True


class OversampleSMOTEN(_Synthetic):
    """For strings alone: rows are as far apart as the classes of their values are distributed differently."""

    category, with_names = "oversampling", True

    def numbers(self, df):
        return []

    def space(self, x, codes, labels, smallest):
        classes, tables = sorted(set(labels), key=str), []
        at = np.array([classes.index(y) for y in labels])
        for j in range(codes.shape[1]):
            counts = np.zeros((int(codes[:, j].max(initial=0)) + 1, len(classes)))
            np.add.at(counts, (codes[:, j], at), 1)
            share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            tables.append(np.abs(share[:, None] - share[None]).sum(2) ** 2)

        def measure(points, rows):
            a, b = points.astype(np.int64), rows.astype(np.int64)
            return sum(t[a[:, j]][:, b[:, j]] for j, t in enumerate(tables))

        return codes.astype(float), measure


class OversampleSMOTENC(_Synthetic):
    """For numbers and strings: a different string counts as half the median deviation of the smallest class's numbers
    in each of two dimensions."""

    category, with_names = "oversampling", True

    def space(self, x, codes, labels, smallest):
        own = x[labels == smallest]
        half = float(np.median(np.nanstd(own, axis=0))) / 2 if x.shape[1] else 1.0
        hot = [np.eye(int(codes[:, j].max(initial=0)) + 1)[codes[:, j]] * half for j in range(codes.shape[1])]
        return np.concatenate([x, *hot], 1), None


class OversampleSMOTEOrRandom(_Resample):
    category = "oversampling"
    domains = {"n_neighbors": Domain(5, 2, 100), "ratio_to_majority": Domain(0.5, 0, 1, whole=False), "max_rows": Domain(LIMIT, 1, 10**9), "max_columns": Domain(100, 1, 10**6)}

    def _fit(self, df, columns):
        small = len(columns) <= self.params["max_columns"] and df.count() <= self.params["max_rows"]
        self.inner = OversampleSMOTE(n_neighbors=self.params["n_neighbors"]) if small and len(self.numbers(df)) == len(columns) - 1 else OversampleRandom(ratio_to_majority=self.params["ratio_to_majority"])
        self.inner.columns, self.inner.target = columns, self.target

    def _transform(self, df):
        return self.inner._transform(df)


class _Neighbours(_Resample):
    """Keeps rows by what their neighbours are; batches of rows meet all rows, block by block."""

    domains = {"n_neighbors": Domain(5, 2, 100)}
    whole = None  # the class that loses no row, if not the smallest

    def keep(self, x, y, own, refs, keys, labels, smallest, k):
        raise NotImplementedError

    def _transform(self, df):
        n, columns = self.counts(df), self.numbers(df)
        if not n or not columns:
            return df
        smallest = self.whole if self.whole is not None else min(n, key=lambda c: (n[c], str(c)))
        x, carried, keys = references(df.where(q(self.target).isNotNull()), columns, [self.target])
        sc = df.sparkSession.sparkContext
        refs, known = Blocks(sc, x), sc.broadcast((keys, np.array([r[0] for r in carried], dtype=object)))
        k, decide = int(self.params.get("n_neighbors", 2)), self.keep

        @F.pandas_udf("boolean")
        def kept(rows, y, own):
            import pandas as pd

            x = matrix(rows, len(columns))
            return pd.Series(decide(x, y.to_numpy(dtype=object), own.to_numpy(), refs, *known.value, smallest, k))

        return df.where(kept(vector(columns), q(self.target), draw([*columns, self.target], 42)))


class UndersampleENN(_Neighbours):
    """Drops a row of a larger class unless all its neighbours are of its class."""

    category = "undersampling"

    def keep(self, x, y, own, refs, keys, labels, smallest, k):
        _, index = nearest(x, refs, k - 1, own, keys)
        return (labels[index] == y[:, None]).all(1) | (y == smallest)


class UndersampleTomekLinks(_Neighbours):
    """Drops the member of a larger class of each pair of mutual nearest rows of different classes."""

    category = "undersampling"
    domains = {}

    def keep(self, x, y, own, refs, keys, labels, smallest, k):
        if len(refs) < 2:
            return np.ones(len(x), bool)
        _, index = nearest(x, refs, 1, own, keys)
        mate = index[:, 0]
        _, back = nearest(refs.take(mate), refs, 1, keys[mate], keys)
        mutual = keys[back[:, 0]] == own
        return ~(mutual & (labels[mate] != y) & (y != smallest))


class UndersampleOSS(_Resample):
    """One-sided selection: of a larger class stay one row and those that the smallest class and this row misclassify
    by their nearest rows; then the larger classes' members of mutual nearest pairs go."""

    category = "undersampling"
    domains = {"n_neighbors": Domain(5, 1, 100)}

    def _transform(self, df):
        n, columns = self.counts(df), self.numbers(df)
        if not n or not columns:
            return df
        smallest, k, target = min(n, key=lambda c: (n[c], str(c))), int(self.params["n_neighbors"]), self.target
        x, _, _ = references(df.where(q(target) == F.lit(smallest)), columns)
        refs = Blocks(df.sparkSession.sparkContext, x)
        key = draw([*columns, target], 42)
        firsts = df.where(q(target).isNotNull()).groupBy(q(target)).agg(F.min(key).alias("key"), F.min_by(vector(columns), key).alias("x")).collect()  # a row for each class
        seeds = {r[0]: (r["key"], np.array([np.nan if v is None else v for v in r["x"]], float)) for r in firsts}

        @F.pandas_udf("boolean")
        def kept(rows, y, own):
            import pandas as pd

            x, out = matrix(rows, len(columns)), np.ones(len(rows), bool)
            for c in set(y.dropna()) - {smallest}:
                at = np.flatnonzero((y == c).to_numpy())
                seed, point = seeds[c]
                near = nearest(x[at], refs, k)[0]
                to_seed = nearest(x[at], point[None], 1)[0]
                among = (near < to_seed).sum(1) < k  # the one row of its class is among the nearest
                others = np.minimum(k - among, near.shape[1])
                out[at] = (own.to_numpy()[at] == seed) | ~((others < among) | ((others == among) & (str(c) < str(smallest))))
            return pd.Series(out)

        tomek = UndersampleTomekLinks()
        tomek.columns, tomek.target, tomek.whole = self.columns, target, smallest
        return tomek._transform(df.where(kept(vector(columns), q(target), key)))


class UndersampleIHT(_Resample):
    """Instance hardness: of each larger class the rows stay that a forest fitted on other folds finds likeliest to be
    of their class, about as many as the smallest class has."""

    category = "undersampling"
    domains = {"trees": Domain(20, 1, 1000), "folds": Domain(5, 2, 100)}

    def _transform(self, df):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        n, columns, k = self.counts(df), self.numbers(df), int(self.params["folds"])
        texts = [f.name for f in df.schema if f.name != self.target and Feature.of(f.dataType) is Feature.CATEGORICAL]
        if not n or len(n) < 2 or not [*columns, *texts]:
            return df
        smallest, classes = min(n, key=lambda c: (n[c], str(c))), sorted(n, key=str)
        means = stats(df, **{str(i): F.avg(clean(c, df)) for i, c in enumerate(columns)}) if columns else {}
        given = [F.coalesce(clean(c, df), F.lit(means[str(i)] or 0.0)).alias(f"x{i}_") for i, c in enumerate(columns)]
        given += [(F.pmod(F.xxhash64(q(c)), F.lit(1 << 20)) / F.lit(1 << 20)).alias(f"t{i}_") for i, c in enumerate(texts)]  # a place of its own for a value
        label = F.lit(None).cast("double")
        for i, c in enumerate(classes):
            label = F.when(q(self.target) == F.lit(c), float(i)).otherwise(label)
        dealt = folds(df.select("*", *given, label.alias("label_")), k, [self.target], df.columns, name="fold_")
        names = [*(f"x{i}_" for i in range(len(columns))), *(f"t{i}_" for i in range(len(texts)))]
        base = shared_table(VectorAssembler(inputCols=names, outputCol="features_").transform(dealt).drop(*names), "folds")
        scored = []
        for i in range(k):
            forest = RandomForestClassifier(labelCol="label_", featuresCol="features_", numTrees=int(self.params["trees"]), seed=7)
            model = forest.fit(base.where((F.col("fold_") != i) & F.col("label_").isNotNull()))
            likely = F.get(vector_to_array("probability"), F.col("label_").cast("int"))
            scored.append(model.transform(base.where(F.col("fold_") == i)).select(*[q(c) for c in df.columns], likely.alias("likely_")))
        out = shared_table(reduce(DataFrame.unionByName, scored), "hardness")
        limits = {}
        for c, own in n.items():
            if c != smallest:
                limits[c] = out.where(q(self.target) == F.lit(c)).agg(F.percentile("likely_", F.lit(1.0 - n[smallest] / own))).first()[0]
        stays = q(self.target).isNull() | (q(self.target) == F.lit(smallest))
        for c, limit in limits.items():
            stays = stays | ((q(self.target) == F.lit(c)) & (F.col("likely_") >= F.lit(limit)))
        return out.where(stays).drop("likely_")


class UndersampleNearMiss(_Resample):
    """Of each larger class as many rows as the smallest has: those with the least mean distance to their nearest
    rows of the smallest class."""

    category = "undersampling"
    domains = {"n_neighbors": Domain(5, 1, 100)}

    def _transform(self, df):
        n, columns = self.counts(df), self.numbers(df)
        if not n or not columns:
            return df
        smallest = min(n, key=lambda c: (n[c], str(c)))
        x, _, _ = references(df.where(q(self.target) == F.lit(smallest)), columns)
        refs = Blocks(df.sparkSession.sparkContext, x)
        k = int(self.params["n_neighbors"])

        @F.pandas_udf("double")
        def mean_distance(rows):
            import pandas as pd

            x = matrix(rows, len(columns))
            return pd.Series(nearest(x, refs, k)[0].mean(1))

        measured = df.withColumn("mean_", mean_distance(vector(columns)))
        out = df.where(q(self.target) == F.lit(smallest))
        for c in sorted((c for c in n if c != smallest), key=str):
            out = out.unionByName(measured.where(q(self.target) == F.lit(c)).orderBy("mean_", *[q(a) for a in df.columns]).limit(n[smallest]).drop("mean_"))
        return out


class UndersampleClusterCentroids(_Resample):
    """Replaces each larger class by the centres of as many clusters as the smallest class has rows."""

    category = "undersampling"

    def _transform(self, df):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler
        import pandas as pd

        n, columns = self.counts(df), self.numbers(df)
        if not n or not columns:
            return df
        smallest = min(n, key=lambda c: (n[c], str(c)))
        out = df.where(q(self.target) == F.lit(smallest)).select(*columns, self.target)
        for c in sorted((c for c in n if c != smallest), key=str):
            own = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df.where(q(self.target) == F.lit(c)).select(*[clean(a, df).alias(a) for a in columns]))
            centres = KMeans(k=max(2, n[smallest]), seed=7, maxIter=20).fit(own).clusterCenters()
            out = out.unionByName(df.sparkSession.createDataFrame(pd.DataFrame(np.array(centres), columns=columns).assign(**{self.target: c})).select(*columns, q(self.target).cast(df.schema[self.target].dataType)))
        return out
