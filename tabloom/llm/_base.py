"""What the corpus operators share: byte-level text access, samples, fold rules; tables of the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.storage import release, shared_dir, shared_path, shared_table  # noqa: F401

#: Bytes that separate words: [\x20\x09-\x0D].
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)), F.lit(0))


def training_sample(df: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """A hash-drawn sample of about `rows` rows of df (all of them where df is smaller).

    Used only to fit classifiers and to warm a model up; the draw depends on doc_id alone, so reruns agree.
    """
    total = df.select("doc_id").count()
    return df.where(_draw(seed) < int((1 << 30) * rows / total)) if total > rows else df


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))


def bounded_texts(df: DataFrame, text_bytes: int, total_bytes: int, seed: int = 7) -> DataFrame:
    """df, a sample of bounded rows, so that its texts have about total_bytes at most: rows are left out by the same
    draw until they do. A text over text_bytes is represented by four passages of it at hash-drawn places."""
    size = F.octet_length("text")
    sizes = sorted(tuple(r) for r in df.select(_draw(seed), F.least(F.coalesce(size, F.lit(0)), F.lit(text_bytes))).collect())
    held, limit = 0, None
    for draw, n in sizes:
        held += n
        if held > total_bytes:
            limit = draw
            break
    if limit is not None:
        df = df.where(_draw(seed) < limit)
    chars = max(1, text_bytes // 16)  # four passages of characters of at most four bytes
    room = F.greatest(F.length("text") - chars, F.lit(1))
    passages = [F.substring("text", F.pmod(F.xxhash64(F.lit(seed + i), "doc_id"), room).cast("int") + 1, F.lit(chars)) for i in range(4)]
    return df.withColumn("text", F.when(size <= text_bytes, F.col("text")).otherwise(F.concat_ws("\n", *passages)))


def plain(docs: DataFrame, *named: str) -> DataFrame:
    """docs with every column but the named ones renamed by place, so that no helper column can clash with one."""
    return docs.toDF(*[c if c in named else f"extra{i}_" for i, c in enumerate(docs.columns)])


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES at most (or one row), unless the session says otherwise itself.

    Both sides of a Python stage hold each batch several times, the JVM outside its heap and for good.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in bounded batches; a worker gives its free memory back after each task."""
    bounded_batches(df.sparkSession)

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return what the allocators hold without use: workers outlive their tasks and share a machine."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def byte_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def split(column):
    """(words of each text, words of all texts laid end to end) of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(column.fill_null(""))))
    words = lists.flatten().cast(pa.binary())
    some = pc.not_equal(pc.binary_length(words), 0)  # a text without words is split into one empty string
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.all(some, min_count=0).as_py():
        return lengths, words
    counts = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(lengths)
    return counts[ends] - counts[ends - lengths], words.filter(some)


def chunks(column, size: int = 1 << 21) -> Iterator:
    """Slices of an Arrow string column of about size bytes; a longer text is whole in one."""
    import pyarrow.compute as pc

    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + size, "right")))
        yield column.slice(at, to - at)
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return out


def blocks(texts: list, size: int) -> Iterator[tuple[int, int]]:
    """Index ranges of texts whose lengths sum to about size; one at least."""
    at, total = 0, 0
    for i, text in enumerate(texts):
        if i > at and total + len(text) > size:
            yield at, i
            at, total = i, 0
        total += len(text)
    if at < len(texts):
        yield at, len(texts)
