"""A data profile from a few fused passes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.core import Dataset, Feature, feature_columns
from tabloom.functions import clean, nearest_quantiles, stats
from tabloom.operators.basic import StrDecode, StrToTemporal, q


class Profile:
    """Statistics of a dataset, each computed when first asked for and kept."""

    def __init__(self, ds: Dataset):
        self.ds, self.df = ds, ds.df

    @cached_property
    def n_rows(self) -> int:
        return self.df.count()

    @cached_property
    def data_types(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.df.schema}

    @cached_property
    def feature_types(self) -> dict[str, Feature]:
        return {f.name: Feature.of(f.dataType) for f in self.df.schema}

    @cached_property
    def str_subtypes(self) -> dict[str, str]:
        own = feature_columns(self.df, Feature.CATEGORICAL)
        if not own:
            return {}
        return {**{c: "temporal" for c in StrToTemporal.detect(self.df, own)}, **{c: "decodable" for c in StrDecode.detect(self.df, own)}}

    @cached_property
    def missing(self) -> dict[str, int]:
        got = stats(self.df, **{str(i): F.count_if(q(c).isNull()) for i, c in enumerate(self.df.columns)})
        return {c: got[str(i)] for i, c in enumerate(self.df.columns)}

    @cached_property
    def duplicates(self) -> int:
        return self.n_rows - self.df.distinct().count()

    def duplicates_approx(self) -> int:
        return max(0, self.n_rows - self.df.agg(F.approx_count_distinct(F.xxhash64(*self.df.columns), 0.01)).first()[0])

    def numeric_frame(self) -> DataFrame:
        """One row per numeric column."""
        own = feature_columns(self.df, Feature.NUMERIC)
        parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), clean(c, self.df).alias("v")) for c in own])).alias("x")
        return self.df.select(parts).select("x.*").groupBy("column").agg((F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("unique_count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.median("v").alias("median"), F.max("v").alias("max"))

    def numeric_stats(self) -> DataFrame:
        """numeric_frame with the quarters, which are values of the column (nearest rank)."""
        quarters = nearest_quantiles(self.df, own := feature_columns(self.df, Feature.NUMERIC), [0.25, 0.75])
        rows = self.df.sparkSession.createDataFrame([(c, *quarters[c]) for c in own], "column string, q25 double, q75 double")
        return self.numeric_frame().join(F.broadcast(rows), "column").select("column", "unique_count", "mean", "std", "min", "q25", "median", "q75", "max")

    def categorical_frame(self) -> DataFrame:
        """One row per string column, over how often its values occur."""
        own = feature_columns(self.df, Feature.CATEGORICAL)
        parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("v")) for c in own])).alias("x")
        counts = self.df.select(parts).select("x.*").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.median("n").alias("median"), F.max("n").alias("max"), F.mode("n", True).alias("mode"))

    @cached_property
    def outlier_columns(self) -> list[str]:
        own = feature_columns(self.df, Feature.NUMERIC)
        if not own:
            return []
        ends = stats(self.df, **{f"{i}{k}": f(clean(c, self.df)) for i, c in enumerate(own) for k, f in (("a", F.min), ("b", F.max))})
        quarters = nearest_quantiles(self.df, own, [0.25, 0.75])
        return [c for i, c in enumerate(own) if (lo := quarters[c][0]) is not None and (lo - 1.5 * (quarters[c][1] - lo) > ends[f"{i}a"] or quarters[c][1] + 1.5 * (quarters[c][1] - lo) < ends[f"{i}b"])]

    @cached_property
    def imbalanced(self) -> bool:
        if not self.ds.target or not self.ds.categorical_target:
            return False
        row = self.df.groupBy(q(self.ds.target)).count().agg(F.max("count"), F.min("count")).first()
        return bool(row[1]) and row[0] / row[1] > 1.5

    def summary(self) -> DataFrame:
        rows = [
            ("shape_n_rows", self.n_rows), ("shape_n_columns", len(self.df.columns)), ("data_types_count", len({*self.data_types.values()})), ("str_subtypes_count", len(self.str_subtypes)),
            ("feature_types_count", len({*self.feature_types.values()})), ("missing_values_count", sum(self.missing.values())), ("duplicates_count", self.duplicates), ("cols_w_outliers", len(self.outlier_columns)), ("imbalanced_target", int(self.imbalanced)),
        ]
        return self.df.sparkSession.createDataFrame([(k, float(v)) for k, v in rows], "summary string, ds double")

    def text(self) -> str:
        """Nine small tables: shape, types, missing values, duplicates, numbers, strings, outliers, imbalance, summary."""
        import pandas as pd

        n, wide = self.n_rows, max(1, len(self.df.columns))
        types = pd.DataFrame({"data_type": self.data_types, "str_subtype": {c: self.str_subtypes.get(c) for c in self.df.columns}, "feature_type": {c: f.value for c, f in self.feature_types.items()}}).T
        missing = pd.DataFrame({c: {"count": k, "ratio": k / max(1, n)} for c, k in {**self.missing, "ds": sum(self.missing.values())}.items()})
        missing.loc["ratio", "ds"] = sum(self.missing.values()) / max(1, n * wide)
        tables = {
            "shape": pd.Series({"n_rows": n, "n_columns": len(self.df.columns)}),
            "types": types,
            "missing_values": missing,
            "duplicates": pd.Series({"count": self.duplicates, "ratio": self.duplicates / max(1, n)}),
            "numeric_stats": self.numeric_stats().toPandas().set_index("column").T if feature_columns(self.df, Feature.NUMERIC) else pd.DataFrame(),
            "categorical_stats": self.categorical_frame().toPandas().set_index("column").T if feature_columns(self.df, Feature.CATEGORICAL) else pd.DataFrame(),
            "cols_w_outliers": pd.Series({"count": len(self.outlier_columns), "columns": ", ".join(self.outlier_columns)}),
            "imbalanced_target": pd.Series({"imbalanced": self.imbalanced}),
            "summary": self.summary().toPandas().set_index("summary")["ds"],
        }
        return "\n\n".join(f"{name}\n{table.to_string()}" for name, table in tables.items())
