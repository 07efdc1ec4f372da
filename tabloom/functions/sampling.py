"""Draws that depend on keys and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(keys: list[str], seed: int) -> Column:
    """A 60-bit number of a row; null keys count as the text `null`."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _ranked(df: DataFrame, by: list[str], keys: list[str], seed: int, buckets: int = 64) -> DataFrame:
    """df with place_ (from 1, in draw order within a class) and size_ of the class, without a task per class: draws
    are cut into ranges, which are ranked by themselves and offset by the counts of the ranges before."""
    df = df.withColumn("draw_", draw(keys, seed)).withColumn("range_", F.shiftright("draw_", 54).cast("int"))
    group = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")).alias(f"group{i}_") for i, c in enumerate(by)]
    names = [f"group{i}_" for i in range(len(by))]
    df = df.select("*", *group)
    counts = df.groupBy(*names, "range_").agg(F.count(F.lit(1)).alias("n_"))
    over = Window.partitionBy(*names) if names else Window.partitionBy()
    counts = counts.withColumn("before_", F.sum("n_").over(over.orderBy("range_")) - F.col("n_")).withColumn("size_", F.sum("n_").over(over)).drop("n_")
    joined = df.join(counts, [*names, "range_"])
    order = Window.partitionBy(*names, "range_").orderBy("draw_", *[F.col(f"`{k}`") for k in keys])
    return joined.withColumn("place_", F.row_number().over(order) + F.col("before_")).drop("draw_", "range_", "before_", *names)


def split(df: DataFrame, fraction: float, by: list[str], keys: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; of each class round(fraction x size) rows, half away from zero, are for the test."""
    ranked = _ranked(df, by, keys, seed)
    test = F.col("place_") <= F.floor(F.col("size_") * fraction + 0.5)
    return ranked.where(~test).drop("place_", "size_"), ranked.where(test).drop("place_", "size_")


def sample(df: DataFrame, n: int, keys: list[str], by: list[str] = (), seed: int = 42) -> DataFrame:
    """n rows, or n of each class."""
    return _ranked(df, list(by), keys, seed).where(F.col("place_") <= n).drop("place_", "size_")


def bounded_sample(df: DataFrame, rows: int, keys: list[str], seed: int = 42) -> DataFrame:
    """About `rows` rows of df by their draw, all if it has no more; for what the driver must hold."""
    n = df.count()
    return df if n <= rows else df.where(draw(keys, seed) < int((1 << 60) * (rows / n)))


def stratified_sample(df: DataFrame, size: int, per_class: int, by: str, keys: list[str], seed: int = 42) -> DataFrame:
    """per_class rows of each class, and as many of the others as `size` still has room for; in draw order."""
    ranked = _ranked(df, [by], keys, seed).withColumn("kept_", F.col("place_") <= per_class).drop("place_", "size_")
    held = ranked.where("kept_")
    room = size - held.count()
    more = sample(ranked.where("NOT kept_"), max(0, room), keys, seed=seed + 1)
    return held.unionByName(more).drop("kept_")


def subsample(df: DataFrame, size: int, target: str | None, keys: list[str], per_class: int = 2, seed: int = 42) -> DataFrame:
    """At most `size` rows: by class in proportion where each class then has a row; else some of each class and others
    at random; without a target at random."""
    total = df.count()
    if total <= size:
        return df
    if target is None:
        return sample(df, size, keys, seed=seed)
    least, classes = df.groupBy(F.col(f"`{target}`")).count().agg(F.min("count"), F.count(F.lit(1))).first()
    if least * size >= total and classes <= size:
        return split(df, size / total, [target], keys, seed)[1]
    if classes * per_class <= size:
        return stratified_sample(df, size, per_class, target, keys, seed)
    return sample(df, size, keys, seed=seed)


def folds(df: DataFrame, k: int, by: list[str], keys: list[str], seed: int = 42, name: str = "fold") -> DataFrame:
    """df with a fold from 0 to k - 1, of each class in turn in draw order."""
    return _ranked(df, by, keys, seed).withColumn(name, F.pmod(F.col("place_") - 1, F.lit(k)).cast("int")).drop("place_", "size_")
