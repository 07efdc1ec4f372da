"""Analytics over experiment results: log parsing, two-level aggregation, best-of-group, wins, levels, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a results log: `>> name: value`.
_FIELDS = {"i_dataset": ("task", "int"), "task": ("task type", "string"), "repeat": ("repeat", "int"), "fold": ("fold", "int"), "pipeline": ("pipeline", "string")}
_KEYS = ["i_dataset", "n_rows", "n_cols", "task", "metric", "pipeline", "model", "extra_metric"]


def parse_log(spark, path: str) -> DataFrame:
    """Leaderboard rows of logs with the fields that precede them, carried forward per file by windows."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    carried = {k: F.last(F.nullif(F.regexp_extract("value", rf"^>> {name}: (\S+)", 1), F.lit("")), ignorenulls=True).over(w).cast(t) for k, (name, t) in _FIELDS.items()}
    for k in ("train prep", "fit models", "test prep", "eval models"):
        carried[k.replace(" ", "_") + "_time"] = F.last(F.nullif(F.regexp_extract("value", rf"^>> {k} time: ([\d.]+)", 1), F.lit("")), ignorenulls=True).over(w).cast("double")
    for k in ("rows", "columns"):
        carried["n_rows" if k == "rows" else "n_cols"] = F.last(F.nullif(F.regexp_extract("value", rf"shape_n_{k}\W+([\d.]+)", 1), F.lit("")), ignorenulls=True).over(w).cast("double").cast("bigint")
    head = F.last(F.when(F.col("value").rlike(r"^\s*model\s"), F.col("value")).when(F.col("value").startswith(">>"), F.lit("")), ignorenulls=True).over(w)
    rows = lines.withColumns(carried).withColumn("head", F.split(F.trim(head), r"\s+")).where(F.col("value").rlike(r"^\s*\d+\s+\S") & (F.size("head") > 1))
    cells = F.split(F.trim(F.regexp_replace("value", r"^\s*\d+\s+", "")), r"\s+")
    rows = rows.withColumn("cell", F.map_from_arrays("head", F.slice(cells, 1, F.size("head"))))
    number = lambda k: F.try_element_at("cell", F.lit(k)).try_cast("double")
    extra = F.when(F.col("task") == "regression", "r2").when(F.col("task") == "binary", "roc_auc").otherwise("roc_auc_ovr")
    return rows.select("i_dataset", "n_rows", "n_cols", "task", "repeat", "fold", F.col("cell")["eval_metric"].alias("metric"), "pipeline", "train_prep_time", "fit_models_time", "test_prep_time", "eval_models_time", F.col("cell")["model"].alias("model"), number("score_test").alias("score"), number("pred_time_test").alias("pred_time"), number("fit_time").alias("fit_time"), extra.alias("extra_metric"), F.try_element_at("cell", extra).try_cast("double").alias("extra_score"), number("accuracy").alias("accuracy_score"), number("balanced_accuracy").alias("balanced_accuracy_score"))


#: Names of models as they are logged, and as they are listed, in order of kind.
MODEL_NAMES = {
    "LinearModel": "a_LinearModel",
    "KNeighbors": "b_KNeighbors",
    "RandomForest": "c_RandomForest",
    "ExtraTrees": "d_ExtraTrees",
    "XGBoost": "e_XGBoost",
    "LightGBM": "f_LightGBM",
    "CatBoost": "g_CatBoost",
    "NeuralNetFastAI": "h_NeuralNetFastAI",
    "TabM": "i_TabM",
    "TabDPT": "j_TabDPT",
    "RealTabPFN-v2.5": "k_RealTabPFN-v2.5",
}
#: Kinds of models by listed name.
TREES = ["c_RandomForest", "d_ExtraTrees", "e_XGBoost", "f_LightGBM", "g_CatBoost"]
NETWORKS = ["h_NeuralNetFastAI", "i_TabM"]
FOUNDATION = ["j_TabDPT", "k_RealTabPFN-v2.5"]


def listed(df: DataFrame) -> DataFrame:
    """Models by their listed names; other names stay."""
    names = F.create_map(*[F.lit(x) for pair in MODEL_NAMES.items() for x in pair])
    return df.withColumn("model", F.coalesce(F.try_element_at(names, F.col("model")), F.col("model")))


def performance(df: DataFrame) -> DataFrame:
    """The columns that analytics need, in order of dataset, pipeline and model."""
    own = ["i_dataset", "task", "metric", "extra_metric", "pipeline", "model", "score", "score_std", "extra_score", "extra_score_std", "accuracy_score", "balanced_accuracy_score"]
    return df.select(*own).orderBy("i_dataset", "pipeline", "model")


def by_metric(df: DataFrame) -> DataFrame:
    """A row for each of both accuracies of a classification result."""
    both = df.where(F.col("task").isin("binary", "multiclass")).withColumnsRenamed({"accuracy_score": "accuracy", "balanced_accuracy_score": "balanced_accuracy"})
    return both.unpivot(["i_dataset", "model", "pipeline"], ["accuracy", "balanced_accuracy"], "acc_metric", "acc_score")


def ratios(df: DataFrame, score: str = "extra_score") -> DataFrame:
    """Seven whole percentages, of a frame with listed models: results without preparation that failed; pairs of
    dataset and model that the best preparation betters; datasets won without preparation by trees and by one of them,
    and with the best by foundation models, by one of them, and by networks."""
    own = F.when(~F.isnan(score), F.col(score))
    none, basic = F.col("pipeline") == "1_No_prep", F.col("pipeline") == "2_Basic"
    pairs = df.groupBy("i_dataset", "model").agg(F.count_if(none).alias("tried"), F.count_if(none & own.isNull()).alias("failed"), F.coalesce(F.max(F.when(none, own)), F.max(F.when(basic, own))).alias("minimal"), F.max(F.when(none, own)).alias("no_prep"), F.coalesce(F.max(own), F.lit(0.0)).alias("best"))
    won = lambda c: F.min_by("model", F.when(F.col(c) > 0, F.struct(-F.col(c), "model")))
    datasets = pairs.groupBy("i_dataset").agg(F.sum("tried").alias("tried"), F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("best") > F.col("minimal")).alias("gained"), won("no_prep").alias("plain"), won("best").alias("top"))
    share = lambda a, b: F.round(F.try_divide(a * 100.0, b)).cast("int")
    n = F.count(F.lit(1))
    return datasets.agg(
        share(F.sum("failed"), F.sum("tried")).alias("no_prep_failed"),
        share(F.sum("gained"), F.sum("pairs")).alias("best_gains"),
        share(F.count_if(F.col("plain").isin(TREES)), n).alias("no_prep_tree_wins"),
        share(F.count_if(F.col("plain") == "g_CatBoost"), n).alias("no_prep_catboost_wins"),
        share(F.count_if(F.col("top").isin(FOUNDATION)), n).alias("best_foundation_wins"),
        share(F.count_if(F.col("top") == "k_RealTabPFN-v2.5"), n).alias("best_tabpfn_wins"),
        share(F.count_if(F.col("top").isin(NETWORKS)), n).alias("best_network_wins"),
    )


def normalise(df: DataFrame) -> DataFrame:
    """AUC to 2 AUC - 1; scores below 0 to 0, null stays null."""
    def floor(c):
        return F.when(c < 0, 0.0).otherwise(c)

    auc = F.col("metric").startswith("roc_auc")
    return df.withColumn("score", floor(F.when(auc, 2 * F.col("score") - 1).otherwise(F.col("score")))).withColumn("extra_score", floor(F.when(F.col("extra_metric").startswith("roc_auc"), 2 * F.col("extra_score") - 1).otherwise(F.col("extra_score"))))


def aggregate(df: DataFrame) -> DataFrame:
    """Means over folds, then means and deviations over repeats."""
    scores = ["score", "extra_score", "accuracy_score", "balanced_accuracy_score"]
    times = ["train_prep_time", "fit_models_time", "test_prep_time", "eval_models_time", "pred_time", "fit_time"]
    folds = df.groupBy(*_KEYS, "repeat").agg(*[F.avg(c).alias(c) for c in scores + times])
    return folds.groupBy(*_KEYS).agg(*[F.avg(c).alias(c) for c in scores + times], *[F.stddev_samp(c).alias(f"{c}_std") for c in scores])


def best(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The row of the largest score of each group; ties by model and pipeline."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), "model", "pipeline")
    return df.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def _won(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    winners = best(df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) > 0)), by, score)
    grid = winners.select("model").distinct().crossJoin(winners.select("pipeline").distinct())  # names only
    counts = winners.groupBy("model", "pipeline").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["model", "pipeline"], "left").select("model", "pipeline", F.coalesce("n", F.lit(0)).alias("win_count"))


def wins_by_pipeline(df: DataFrame) -> DataFrame:
    return _won(df, ["i_dataset", "pipeline"])


def wins_overall(df: DataFrame) -> DataFrame:
    return _won(df, ["i_dataset"])


def metric_win_diff(df: DataFrame) -> DataFrame:
    """Wins by balanced accuracy less wins by accuracy, over the models and pipelines that win by either."""
    sides = [_won(df, ["i_dataset"], s).withColumnRenamed("win_count", s) for s in ("accuracy_score", "balanced_accuracy_score")]
    both = sides[0].join(sides[1], ["model", "pipeline"], "full")
    return both.select("model", "pipeline", (F.coalesce("balanced_accuracy_score", F.lit(0)) - F.coalesce("accuracy_score", F.lit(0))).alias("win_diff"))


def levels(df: DataFrame) -> DataFrame:
    """Per dataset and model: scores without preparation, with the minimal one (no_prep, else basic), and the best."""
    ranked = F.when(F.col("pipeline") == "1_No_prep", 0).when(F.col("pipeline") == "2_Basic", 1)
    score = F.when(~F.isnan("score"), F.col("score"))
    return df.groupBy("i_dataset", "model").agg(F.max(F.when(F.col("pipeline") == "1_No_prep", score)).alias("no_prep"), F.min_by(score, F.when(score.isNotNull(), ranked)).alias("minimal"), F.coalesce(F.max(score), F.lit(0.0)).alias("best"))


def level_diffs(df: DataFrame) -> DataFrame:
    def up(a, b):
        return F.when(F.col(a) - F.col(b) < 0, 0.0).otherwise(F.col(a) - F.col(b))

    return levels(df).select("i_dataset", "model", up("minimal", "no_prep").alias("diff_minimal_no_prep"), up("best", "minimal").alias("diff_best_minimal"))


def percentages(df: DataFrame) -> DataFrame:
    """Shares of dataset and model pairs, in one pass: failed without preparation, gained by it, best without."""
    share = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 2)
    lv = levels(df)
    return lv.agg(share(F.col("no_prep").isNull() | (F.col("no_prep") <= 0)).alias("no_prep_failed"), share(F.col("best") > F.coalesce("no_prep", F.lit(0.0))).alias("gained"), share(F.col("best") == F.col("no_prep")).alias("best_without_prep"))


def pivot(df: DataFrame, models: list[str]) -> DataFrame:
    return level_diffs(df).groupBy("i_dataset").pivot("model", models).agg(F.first("diff_best_minimal"))


def sankey(df: DataFrame) -> DataFrame:
    """Win counts by model, by pipeline, and by both."""
    won = wins_overall(df)
    won.createOrReplaceTempView("tabloom_wins")
    return df.sparkSession.sql("SELECT model, pipeline, sum(win_count) AS win_count FROM tabloom_wins GROUP BY GROUPING SETS ((model), (pipeline), (model, pipeline))")
