"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tabloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Folders that shared_path has given out, by application.
_GIVEN: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    What is read stays until clear() or release(), as results are lazy.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path_ = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(table: DataFrame) -> None:
    """Delete what shared_table wrote, once nothing reads it any more."""
    path = getattr(table, "shared_path_", None)
    given = _GIVEN.get(table.sparkSession.sparkContext.applicationId, [])
    if path in given:
        given.remove(path)
        _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> int:
    """Delete all that this application has written so and not released; for when its results have been consumed."""
    given = _GIVEN.pop(spark.sparkContext.applicationId, [])
    for path in given:
        _delete(spark, path)
    return len(given)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written in ranges of the order, with place_ (from 0 on, over all rows) and part_ (its range); no task sees more
    than a range. Rows that are equal in the order are interchangeable."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared_table(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "placed")
    part, before = F.shiftright("at_", 33).cast("int"), {}
    for p, k in sorted(tuple(r) for r in dealt.groupBy(part).count().collect()):  # one row for each range
        before[p] = (before[max(before)] + last) if before else 0
        last = k
    return dealt.withColumn("part_", part).withColumn("place_", F.col("at_") - F.shiftleft(F.shiftright("at_", 33), 33) + by_part(before)).drop("at_")


def by_part(values: dict[int, object]) -> Column:
    """The value for a row's part_."""
    if not values:
        return F.lit(0)
    return F.element_at(F.array(*[F.lit(values.get(p)) for p in range(max(values) + 1)]), F.col("part_") + 1)
