"""Experiments, results, sources, searches, saved pipelines and streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom import errors, sources
from tabloom.core import Dataset, Pipeline, Role
from tabloom.functions import sampling
from tabloom.functions.profile import Profile
from tabloom.operators import operator
from tabloom.plans import results
from tabloom.plans.experiment import MODELS, Experiment, evaluate
from tabloom.plans.pipelines import random_search
from tabloom.streaming import transform_stream


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2))
    y = np.where(x[:, 0] + 0.2 * rng.normal(size=240) > 0.4, "yes", "no")
    return spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "kind": [f"k{i % 4}" for i in range(240)], "y": y}))


def test_experiment_and_its_log(spark, table, tmp_path):
    regression = table.select("a", "b", (F.col("a") * 3 - F.col("b")).alias("y"))
    done = Experiment([(table, "y"), (regression, "y")], ["1_No_prep", "2_Basic"], ["LR", "KNN", "NB"], lite=True, log=f"{tmp_path}/log.txt").run()
    rows = {(r.i_dataset, r.pipeline, r.model): r for r in done.collect()}
    assert len(rows) == 12 and {r.task for r in rows.values()} == {"binary", "regression"}
    assert math.isnan(rows[(0, "1_No_prep", "LinearModel")].score)  # strings are left as they are
    assert rows[(0, "2_Basic", "LinearModel")].score > 0.9 and rows[(0, "2_Basic", "KNeighbors")].accuracy_score > 0.7
    assert rows[(1, "1_No_prep", "LinearModel")].extra_score == pytest.approx(1) and math.isnan(rows[(1, "1_No_prep", "NaiveBayes")].score)
    assert rows[(1, "1_No_prep", "LinearModel")].metric == "root_mean_squared_error" and rows[(1, "2_Basic", "KNeighbors")].accuracy_score is None
    again = {(r.i_dataset, r.pipeline, r.model): r for r in results.parse_log(spark, f"{tmp_path}/log.txt").collect()}
    assert set(again) == set(rows)
    for key, r in rows.items():
        p = again[key]
        assert (p.task, p.n_rows, p.n_cols, p.repeat, p.fold, p.metric, p.extra_metric) == (r.task, r.n_rows, r.n_cols, 0, 0, r.metric, r.extra_metric)
        assert p.score == pytest.approx(r.score, abs=1e-5, nan_ok=True) and (p.extra_score or math.nan) == pytest.approx(r.extra_score, abs=1e-5, nan_ok=True)
        assert p.train_prep_time == pytest.approx(r.train_prep_time)
    board = results.aggregate(results.normalise(done))
    assert results.ratios(results.listed(board)).first().no_prep_failed > 0


def test_repeats_by_rows():
    e = Experiment([])
    assert [e.times(n) for n in (10, 2000, 10_000, 50_000)] == [(8, 3), (4, 3), (2, 3), (1, 3)]


def test_scores_by_hand(spark):
    rows = [(0.0, 0.0, [0.7, 0.2, 0.1]), (0.0, 1.0, [0.3, 0.5, 0.2]), (1.0, 1.0, [0.1, 0.8, 0.1]), (2.0, 2.0, [0.2, 0.2, 0.6]), (2.0, 0.0, [0.5, 0.1, 0.4]), (2.0, 2.0, [0.1, 0.3, 0.6])]
    got = evaluate(spark.createDataFrame(rows, "label double, prediction double, probability array<double>"), "multiclass", 3)

    def auc(c):
        pos, neg = [p[c] for y, _, p in rows if y == c], [p[c] for y, _, p in rows if y != c]
        return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])

    assert got["accuracy"] == pytest.approx(4 / 6) and got["balanced_accuracy"] == pytest.approx((1 / 2 + 1 + 2 / 3) / 3)
    assert got["log_loss"] == pytest.approx(np.mean([math.log(p[int(y)]) for y, _, p in rows]))
    assert got["roc_auc_ovr"] == pytest.approx(np.mean([auc(c) for c in range(3)]))
    numbers = [(1.0, 1.5), (2.0, 1.0), (4.0, 4.5)]
    got = evaluate(spark.createDataFrame(numbers, "label double, prediction double"), "regression", 0)
    y = np.array([a for a, _ in numbers])
    gap = np.array([a - b for a, b in numbers])
    assert got["r2"] == pytest.approx(1 - (gap**2).sum() / ((y - y.mean()) ** 2).sum()) and got["root_mean_squared_error"] == pytest.approx(-math.sqrt((gap**2).mean()))


def test_learners_learn(spark, table):
    df = table.select("a", "b", (F.col("y") == "yes").cast("double").alias("label"))
    for name in ("DT", "MLP"):
        model = MODELS[name][1](["a", "b"], 2).fit(df)
        assert evaluate(model.transform(df), "binary", 2)["accuracy"] > 0.85, name


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(100)], "i int, y string")
    part = sampling.stratified_sample(df, 20, 4, "y", ["i"])
    counts = dict(part.groupBy("y").count().collect())
    assert part.count() == 20 and counts["b"] >= 4 and part.distinct().count() == 20
    assert dict(sampling.subsample(df, 50, "y", ["i"]).groupBy("y").count().collect()) == {"a": 45, "b": 5}
    assert sampling.subsample(df, 5, "y", ["i"]).count() == 5 and sampling.subsample(df, 500, "y", ["i"]).count() == 100
    dealt = sampling.folds(df, 3, ["y"], ["i"]).groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in dealt if r["y"] == "b") - min(r["count"] for r in dealt if r["y"] == "b") <= 1 and len(dealt) == 6


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    for kind in ("csv", "parquet", "json"):
        sources.save(df, f"{tmp_path}/t.{kind}", kind)
    assert sorted(map(tuple, sources.parse(f"{tmp_path}/t.csv").select("a", "b").collect())) == [(1, "x"), (2, "y")]
    assert sorted(map(tuple, sources.parse(f"{tmp_path}/t.parquet").collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "d.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert sorted(map(tuple, sources.parse(f"{tmp_path}/d.json").collect())) == [(1, "x"), (2, "y")]
    assert sources.to_dict(sources.parse({"a": [1, 2]})) == {"a": [1, 2]} and sources.to_numpy(sources.parse(np.ones((2, 2, 2)))).shape == (2, 4)
    assert sources.parse(pd.DataFrame({"c": pd.Categorical(["p", "q"])})).columns == ["c"]
    assert str(sources.to_pandas(df)["b"].dtype) == "category" and "x" in sources.show(df)
    for bad in ("t.xml", 7):
        with pytest.raises(errors.UnsupportedFormatError):
            sources.parse(bad)
    with pytest.raises(errors.UnsupportedFormatError):
        sources.save(df, f"{tmp_path}/t", "xml")
    side = sources.beside(spark.range(5).select(F.col("id").alias("p")), spark.range(3).select(F.col("id").alias("q")), ["p"], ["q"])
    assert sorted(map(tuple, side.collect())) == [(0, 0), (1, 1), (2, 2), (3, None), (4, None)]
    with pytest.raises(errors.UnsupportedFormatError):
        sources.beside(df, df, ["a"], ["a"])


def test_folders_and_shared_tables(spark, tmp_path):
    from tabloom.functions import storage

    folder = sources.make_folder(f"{tmp_path}/a/b")
    (tmp_path / "a" / "b" / "x").write_text("1")
    assert sources.clear_folder(folder) == folder and not list((tmp_path / "a" / "b").iterdir())
    sources.remove_folder(folder)
    assert not (tmp_path / "a" / "b").exists()
    one, two = (storage.shared_table(spark.range(n), "t") for n in (3, 4))
    storage.release(one)
    assert two.count() == 4
    with pytest.raises(Exception, match="not|exist"):
        one.count()
    assert storage.clear(spark) >= 1 and storage.clear(spark) == 0


def test_profile_text(table):
    said = Profile(Dataset(table, target="y")).text()
    assert all(f"{t}\n" in said for t in ("shape", "types", "missing_values", "duplicates", "numeric_stats", "categorical_stats", "cols_w_outliers", "imbalanced_target", "summary"))
    assert "q25" in said and "feature_type" in said


def test_pipelines_save_search_and_invert(spark, table, tmp_path):
    train = Dataset(table, target="y")
    p = Pipeline(operator("Normalize")(), operator("EncodeIntTarget")())
    out = p.fit_transform(train)
    p.save(f"{tmp_path}/p")
    again = Pipeline.load(f"{tmp_path}/p")
    assert sorted(map(str, again.transform(train).df.collect())) == sorted(map(str, out.df.collect()))
    assert set(r.y for r in p.inverse_transform(out).df.select("y").collect()) == {"yes", "no"} and [list(r) for r in p.report()] == [["Normalize"], ["EncodeIntTarget"]]
    with pytest.raises(errors.DatasetTypeError):
        Pipeline(operator("Normalize")()).fit_transform(Dataset(table, role="test"))
    with pytest.raises(errors.NotFittedError):
        operator("Normalize")().transform(train)
    with pytest.raises(errors.HyperparameterNameError):
        operator("Normalize")(nothing=1)
    # row filters run on training data only
    bounds = Pipeline(operator("RemoveOutliersSTD")(["a"], cutoff_coef=2))
    assert bounds.fit_transform(train).df.count() < 240 and bounds.transform(Dataset(table, role=Role.TEST, target="y")).df.count() == 240
    best, score = random_search(Dataset(table.select("a", "b")), evaluate=lambda ds: -len(ds.df.columns), lengths=(1, 2), iterations=3)
    assert best is not None and score <= -1


def test_stream(spark, table, tmp_path):
    p = Pipeline(operator("Standardize")(["a"]), operator("EncodeInt")(["kind"]))
    want = p.fit_transform(Dataset(table)).df
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    transform_stream(p, stream).writeStream.format("memory").queryName("tabloom_out").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(map(str, spark.table("tabloom_out").collect())) == sorted(map(str, want.collect()))
    counted = Pipeline(operator("AggregateDuplicates")())
    counted.fit_transform(Dataset(table))
    with pytest.raises(errors.TransformError):
        transform_stream(counted, stream)
