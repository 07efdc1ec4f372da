"""Evaluates pipelines by models: folds and repeats, timed phases, scores, and a row for every model that fails."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.core import Dataset, Feature, Role, feature_columns
from tabloom.functions import sampling
from tabloom.functions.knn import Blocks, matrix, nearest, references, vector
from tabloom.functions.profile import Profile
from tabloom.functions.storage import shared_table
from tabloom.plans.pipelines import PRESETS, adapt

RESULTS = (
    "i_dataset int, n_rows long, n_cols int, task string, repeat int, fold int, metric string, pipeline string, train_prep_time double, fit_models_time double, "
    "test_prep_time double, eval_models_time double, model string, score double, pred_time double, fit_time double, extra_metric string, extra_score double, "
    "accuracy_score double, balanced_accuracy_score double"
)
#: Metric and extra metric by kind of task; errors count negatively, so more is better.
METRICS = {"regression": ("root_mean_squared_error", "r2"), "binary": ("roc_auc", "roc_auc"), "multiclass": ("log_loss", "roc_auc_ovr")}


class _Neighbours:
    """Predicts by the nearest fitted rows, weighted by nearness. The driver holds the fitted rows once."""

    def __init__(self, columns: list[str], classes: int, k: int = 5):
        self.columns, self.classes, self.k = columns, classes, k

    def fit(self, df: DataFrame) -> _Neighbours:
        self.x, carried, _ = references(df, self.columns, ["label"])
        self.y = np.array([r[0] for r in carried], float)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        sc, columns, classes, k = df.sparkSession.sparkContext, self.columns, self.classes, self.k
        refs, labels = Blocks(sc, self.x), sc.broadcast(self.y)

        @F.pandas_udf("array<double>")
        def guess(rows):
            import pandas as pd

            distance, index = nearest(matrix(rows, len(columns)), refs, k)
            w = np.where(distance[:, :1] == 0, distance == 0, 1 / np.maximum(distance, 1e-300)).astype(float)
            w /= w.sum(1, keepdims=True)
            own = labels.value[index]
            votes = np.stack([(w * (own == c)).sum(1) for c in range(classes)], 1) if classes else (w * own).sum(1)[:, None]
            return pd.Series(list(votes))

        out = df.withColumn("votes_", guess(vector(columns)))
        if not classes:
            return out.withColumn("prediction", F.get("votes_", 0))
        return out.withColumn("probability", F.col("votes_")).withColumn("prediction", (F.array_position("votes_", F.array_max("votes_")) - 1).cast("double"))


def _spark_model(make: Callable) -> Callable:
    """A learner of Spark's library over an assembled vector, its probability as an array."""

    def build(columns: list[str], classes: int):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        class Model:
            def fit(self, df):
                self.own = make(classes, len(columns)).fit(vectors(df))
                return self

            def transform(self, df):
                out = self.own.transform(vectors(df))
                return out.withColumn("probability", vector_to_array("probability")) if classes and "probability" in out.columns else out

        def vectors(df):
            return VectorAssembler(inputCols=columns, outputCol="features").transform(df)

        return Model()

    return build


def _boosted(classes: int, _: int):
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    if classes > 2:
        raise ValueError("boosted trees tell two classes apart")
    return c.GBTClassifier(maxIter=20, seed=7) if classes else r.GBTRegressor(maxIter=20, seed=7)


def _pick(classifier: str, regressor: str | None, **params) -> Callable:
    def make(classes: int, _: int):
        from pyspark.ml import classification, regression

        if not classes and regressor is None:
            raise ValueError("this model is for classes")
        return getattr(classification, classifier)(**params.get("classes", {})) if classes else getattr(regression, regressor)(**params.get("numbers", {}))

    return _spark_model(make)


def _perceptron(classes: int, width: int):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    if not classes:
        raise ValueError("this model is for classes")
    return MultilayerPerceptronClassifier(layers=[width, 32, classes], seed=7, maxIter=100)


#: Learners by name: (name in the results, maker). Nothing is prepared by a learner itself, so each sees just the data
#: that the pipeline made; strings or missing values left in it make it fail.
MODELS: dict[str, tuple[str, Callable]] = {
    "LR": ("LinearModel", _pick("LogisticRegression", "LinearRegression")),
    "KNN": ("KNeighbors", lambda columns, classes: _Neighbours(columns, classes)),
    "RF": ("RandomForest", _pick("RandomForestClassifier", "RandomForestRegressor", classes={"impurity": "entropy", "seed": 7}, numbers={"seed": 7})),
    "DT": ("DecisionTree", _pick("DecisionTreeClassifier", "DecisionTreeRegressor", classes={"seed": 7}, numbers={"seed": 7})),
    "GBM": ("GradientBoosting", _spark_model(_boosted)),
    "MLP": ("Perceptron", _spark_model(_perceptron)),
    "NB": ("NaiveBayes", _pick("NaiveBayes", None, classes={"modelType": "gaussian"})),
    "FM": ("FactorizationMachine", _pick("FMClassifier", "FMRegressor", classes={"seed": 7}, numbers={"seed": 7})),
}


def evaluate(scored: DataFrame, task: str, classes: int) -> dict[str, float]:
    """Scores of predictions (label, prediction, probability): all metrics of the kind of task."""
    if task == "regression":
        gap = F.col("label") - F.col("prediction")
        row = scored.agg(F.avg(gap * gap).alias("mse"), F.var_pop("label").alias("var")).first()
        return {"root_mean_squared_error": -(row["mse"] ** 0.5), "r2": 1 - row["mse"] / row["var"] if row["var"] else float("nan")}
    right = (F.col("label") == F.col("prediction")).cast("double")
    by_class = scored.groupBy("label").agg(F.avg(right).alias("recall"), F.sum(right).alias("right"), F.count(F.lit(1)).alias("n"))
    total = by_class.agg(F.sum("right") / F.sum("n"), F.avg("recall")).first()
    out = {"accuracy": total[0], "balanced_accuracy": total[1]}
    likely = F.greatest(F.lit(1e-15), F.get("probability", F.col("label").cast("int")))
    out["log_loss"] = -scored.agg(F.avg(-F.log(likely))).first()[0]
    curves = [area(scored, c) for c in ([1] if task == "binary" else range(classes))]
    out["roc_auc" if task == "binary" else "roc_auc_ovr"] = float(np.mean(curves))
    return out


def area(scored: DataFrame, c: int) -> float:
    """Area under the curve of class c against the others; over distinct scores, which are sorted in a distributed way."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    own = scored.select((F.col("label") == c).cast("double").alias("label"), F.get("probability", c).alias("rawPrediction"))
    return BinaryClassificationEvaluator(numBins=0).evaluate(own)


@dataclass
class Experiment:
    """tables: (frame, target) by number. A frame's rows are dealt into folds by a draw over their values, of a class
    target in proportion. subsample: (train, test) sizes at most. log: a file of the driver for the text log."""

    tables: list[tuple[DataFrame, str]]
    pipelines: list[str] = field(default_factory=lambda: list(PRESETS))
    models: list[str] = field(default_factory=lambda: list(MODELS))
    lite: bool = False
    subsample: tuple[int, int] | None = None
    repeats: int | None = None
    folds: int | None = None
    log: str | None = None
    append: bool = False

    def times(self, rows: int) -> tuple[int, int]:
        """Repeats and folds of a table: fewer repeats of more rows."""
        if self.lite:
            return 1, 1
        repeats = 8 if rows < 2000 else 4 if rows < 10_000 else 2 if rows < 50_000 else 1
        return self.repeats or repeats, self.folds or 3

    def run(self) -> DataFrame:
        spark, rows = self.tables[0][0].sparkSession, []
        out = open(self.log, "a" if self.append else "w") if self.log else None
        try:
            for i, (df, target) in enumerate(self.tables):
                rows += self._table(i, df, target, lambda line: out and out.write(line + "\n"))
                if out:
                    out.flush()
        finally:
            if out:
                out.close()
        return spark.createDataFrame(rows, RESULTS)

    def _table(self, i: int, df: DataFrame, target: str, write) -> list[tuple]:
        whole = Dataset(df, target=target)
        n, classes = df.count(), df.where(F.col(f"`{target}`").isNotNull()).select(target).distinct().count() if whole.categorical_target else 0
        task = "regression" if not classes else "binary" if classes == 2 else "multiclass"
        repeats, folds = self.times(n)
        write(f">> task type: {task}")
        for r in Profile(whole).summary().collect():
            write(f"│ {r['summary']} ┆ {r['ds']} │")
        rows = []
        for repeat in range(repeats):
            dealt = shared_table(sampling.folds(df, max(2, folds) if folds > 1 else 3, [target] if classes else [], df.columns, seed=42 + repeat, name="fold_"), "folds")
            for fold in range(folds):
                write("-" * 36)
                for line in (f"task: {i}", f"repeat: {repeat}", f"fold: {fold}"):
                    write(f">> {line}")
                train, test = dealt.where(F.col("fold_") != fold).drop("fold_"), dealt.where(F.col("fold_") == fold).drop("fold_")
                if self.subsample:
                    train, test = (sampling.subsample(part, size, target if classes else None, df.columns) for part, size in zip((train, test), self.subsample))
                for pipeline in self.pipelines:
                    write(f">> pipeline: {pipeline}")
                    rows += self._one((i, n, len(df.columns), task, repeat, fold), pipeline, Dataset(train, target=target), Dataset(test, role=Role.TEST, target=target), target, classes, write)
        return rows

    def _one(self, head: tuple, name: str, train: Dataset, test: Dataset, target: str, classes: int, write) -> list[tuple]:
        task, (metric, extra) = head[3], METRICS[head[3]]
        began = time.time()
        pipeline, prepared = adapt(train, name)
        prepared = shared_table(prepared.df, "train")
        at = [began, time.time()]
        values = [r[0] for r in prepared.select(target).where(F.col(f"`{target}`").isNotNull()).distinct().collect()] if classes else []  # a row for each class
        values = sorted(values, key=str)
        label = F.col(f"`{target}`").cast("double")
        if classes:
            label = F.lit(None).cast("double")
            for k, v in enumerate(values):
                label = F.when(F.col(f"`{target}`") == F.lit(v), float(k)).otherwise(label)
        columns = [c for c in prepared.columns if c != target]
        fitted, fit_time = {}, {}
        own = prepared.withColumn("label", label).where("label IS NOT NULL")
        for key in self.models:
            start = time.time()
            try:
                if strings := [c for c in columns if c in feature_columns(prepared, Feature.CATEGORICAL) or c in feature_columns(prepared, Feature.OTHER)]:
                    raise ValueError(f"columns {strings} are no numbers")
                fitted[key] = MODELS[key][1](columns, len(values) if classes else 0).fit(own)
                fit_time[key] = time.time() - start
            except Exception:  # the model fails; its row says so
                continue
        at.append(time.time())
        tested = shared_table(pipeline.transform(test).df, "test").withColumn("label", label).where("label IS NOT NULL")
        at.append(time.time())
        found: dict[str, tuple[dict, float]] = {}
        for key, model in fitted.items():
            start = time.time()
            try:
                scored = shared_table(model.transform(tested).select("label", "prediction", *(["probability"] if classes else [])), "scored")
                found[key] = (evaluate(scored, task, len(values)), time.time() - start)
            except Exception:  # as above
                continue
        at.append(time.time())
        phases = [b - a for a, b in zip(at, at[1:])]
        for k, phase in enumerate(("train prep", "fit models", "test prep", "eval models")):
            write(f">> {phase} time: {phases[k]} s")
        nan, rows, board = float("nan"), [], []
        for key in sorted(self.models, key=lambda k: -found[k][0][metric] if k in found else float("inf")):
            scores, spent = found.get(key, ({}, nan))
            own_fit = fit_time[key] if key in found else nan
            rows.append((*head, metric, name, *phases, MODELS[key][0], *(float(x) for x in (scores.get(metric, nan), spent, own_fit)), extra, *(None if k is None else float(scores.get(k, nan)) for k in (extra, "accuracy" if classes else None, "balanced_accuracy" if classes else None))))
            board.append({"model": MODELS[key][0], "score_test": scores.get(metric, nan), "eval_metric": metric, "pred_time_test": spent, "fit_time": own_fit, **({"accuracy": scores.get("accuracy", nan), "balanced_accuracy": scores.get("balanced_accuracy", nan)} if classes else {}), extra: scores.get(extra, nan)})
        import pandas as pd

        write(">> leaderboard\n" + pd.DataFrame(board).to_string())
        write(f"pipeline {pipeline.report()}")
        return rows
