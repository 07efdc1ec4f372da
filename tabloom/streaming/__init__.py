"""Fitted pipelines over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabloom import errors
from tabloom.core import Dataset, Pipeline, Role


def transform_stream(pipeline: Pipeline, stream: DataFrame, target: str | None = None) -> DataFrame:
    """A stream through those fitted stages that run at inference; stages that need all rows at once are refused."""
    if not pipeline.fitted:
        raise errors.NotFittedError("the pipeline is not fitted")
    for s in pipeline.stages:
        if s.role is Role.INFERENCE and s.changes_rows and type(s).__name__ != "DropNoneRows":
            raise errors.TransformError(f"{type(s).__name__} cannot run on a stream")
    return pipeline.transform(Dataset(stream, role=Role.INFERENCE, target=target)).df
