"""Reading and writing tables."""

from __future__ import annotations

import pathlib
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom import errors
from tabloom.functions.storage import numbered


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.active()


def parse(source, spark: SparkSession | None = None) -> DataFrame:
    """A frame from a frame, a column dict, a pandas frame, an array, or a path ending in csv, parquet or json."""
    import numpy as np
    import pandas as pd

    if isinstance(source, DataFrame):
        return source
    spark = _session(spark)
    if isinstance(source, dict):
        return spark.createDataFrame(pd.DataFrame(source))
    if isinstance(source, pd.DataFrame):
        return spark.createDataFrame(source.assign(**{c: source[c].astype(str) for c in source if isinstance(source[c].dtype, pd.CategoricalDtype)}))
    if isinstance(source, np.ndarray):
        flat = source.reshape(len(source), -1)
        return spark.createDataFrame(pd.DataFrame(flat, columns=[f"column_{i}" for i in range(flat.shape[1])]))
    if isinstance(source, str):
        readers = {"csv": lambda p: spark.read.csv(p, header=True, inferSchema=True), "parquet": spark.read.parquet, "json": lambda p: spark.read.json(p, multiLine=True)}
        if (read := readers.get(source.rstrip("/").rpartition(".")[2].lower())) is not None:
            return read(source)
    raise errors.UnsupportedFormatError(f"cannot read {type(source).__name__} {source if isinstance(source, str) else ''}")


def images(path: str, extension: str = "png", spark: SparkSession | None = None) -> DataFrame:
    """One row per image of a folder, by path: its bytes flattened by Spark's image reader and padded with zeros."""
    data = _session(spark).read.format("image").option("pathGlobFilter", f"*.{extension}").load(path).select(F.col("image.origin").alias("path"), F.transform(F.split(F.hex("image.data"), "(?<=\\G..)"), lambda h: F.conv(h, 16, 10).cast("int")).alias("pixels"))
    widest = data.agg(F.max(F.size("pixels"))).first()[0] or 0
    return data.select("path", *[F.coalesce(F.get("pixels", i), F.lit(0)).alias(f"column_{i}") for i in range(widest)])


def beside(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Columns of both frames, rows paired by their place in the given orders; the longer one's last rows get nulls.

    Places are numbered by ranges, so no task sees a whole frame.
    """
    if taken := set(left.columns) & set(right.columns):
        raise errors.UnsupportedFormatError(f"both frames have {sorted(taken)}")
    left_placed, right_placed = (numbered(df, [F.col(f"`{c}`") for c in order]).drop("part_") for df, order in ((left, left_order), (right, right_order)))
    both = left_placed.join(right_placed, "place_", "full")
    return both.select(*[F.col(f"`{c}`") for c in [*left.columns, *right.columns]])


def save(df: DataFrame, path: str, format: str = "parquet") -> None:
    if format not in ("csv", "parquet", "json"):
        raise errors.UnsupportedFormatError(format)
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if format == "csv" else getattr(writer, format)(path)


def to_pandas(df: DataFrame):
    """The frame on the driver, strings as categories."""
    out = df.toPandas()
    return out.astype({f.name: "category" for f in df.schema if f.dataType.simpleString() == "string"})


def show(df: DataFrame, rows: int = 20, width: int = 0) -> str:
    """A printed frame; width 0 cuts no value."""
    return df._show_string(rows, width or False, False)


def make_folder(path: str) -> str:
    """A folder of the driver, made if it is not there."""
    pathlib.Path(path).mkdir(parents=True, exist_ok=True)
    return path


def clear_folder(path: str) -> str:
    """The folder, with nothing in it."""
    remove_folder(path)
    return make_folder(path)


def remove_folder(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def to_dict(df: DataFrame) -> dict:
    return df.toPandas().to_dict("list")


def to_numpy(df: DataFrame):
    return df.toPandas().to_numpy()
