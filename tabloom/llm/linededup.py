"""Line dedup by a log-template tree.

The tree has a fixed depth: below the root a line goes by its number of tokens, then by its leading tokens, and ends in
a leaf, which holds templates. Tokens with a digit are variable fields at once. Other fields are generalised from the
lines that a leaf has seen: where two different lines agree but for one block of their tokens, that block becomes a
variable field of a template they share. A line therefore has its own template (itself, but for tokens with a digit)
and one for each block that may vary; a template of the second sort exists if two different lines have it. A template
that recurs in several documents is dropped from all but the first (least doc_id) of them.

Nodes are named by 64-bit hashes of what they stand for, which numpy computes for many lines at once: token hashes from
their bytes, and path and template hashes as differences of running sums over tokens. Lines are parsed once and their
names written; templates are counted with partial aggregation, so one in a third of all lines costs each task one row.
What recurs is written too, so that its join is not tied to the count and the lines of a hot template can be split.

Edge cases: null texts stay null with no lines dropped; empty lines are never dropped; lines of fewer than `min_tokens`
tokens (a line without spaces is one token, however long) have only the line as it is for a template; lines of fewer
than `general` tokens have no variable block; repeats within one document do not recur across documents; rows of equal
doc_id are one document, a null doc_id comes after all others and null ids are one document; repeated rows lose equal
lines; very long texts are read whole, a piece at a time; a table without rows gives none. Columns n_lines and
dropped_lines of the input are replaced, others of any name stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import map_arrow, plain, shared_table

_LAST = (1 << 63) - 1
_FIELD = b"<*>"


@dataclass(frozen=True)
class LineParams:
    """depth: leading tokens in the path; blocks: parts of a line of which one may vary, from `general` tokens on;
    min_tokens: tokens from which on those with a digit are variable; min_docs: documents in which a template recurs."""

    depth: int = 2
    blocks: int = 4
    general: int = 8
    min_tokens: int = 3
    min_docs: int = 2


_SPACE, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\x0b\x0c\r", b"0123456789"))
_BYTE = np.random.default_rng(71).integers(0, 1 << 64, 256, np.uint64)
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _tokens(data: bytes, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, whether it has a digit, line) of each token of data, which ends with a line end; read in pieces that are
    cut at white space."""
    parts, at, line = [], 0, 0
    cut = re.compile(rb"[ \t\n\x0b\x0c\r]")
    while at < len(data):
        to = len(data) if at + size >= len(data) else cut.search(data, at + size).end()
        b = np.frombuffer(data, np.uint8, to - at, at)
        space = _SPACE[b]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            inner = np.flatnonzero(~space)
            first = np.cumsum(lengths) - lengths
            place = np.arange(len(inner)) - np.repeat(first, lengths)
            own = b[inner]
            h = np.add.reduceat(_BYTE[own] * _powers(_STEP, int(lengths.max()))[place], first)
            digit = np.add.reduceat(_DIGIT[own], first, dtype=np.int64) > 0
            parts.append((_mix(h + lengths.astype(np.uint64)), digit, line + np.cumsum(b == 10)[starts]))
        line += int((b == 10).sum())
        at = to
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def templates_of(data: bytes, params: LineParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, own template, whether blocks may vary, template for each block) of the lines of data that have tokens."""
    h, digit, line = _tokens(data)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    n = np.diff(first, append=len(h))
    field = _tokens(_FIELD + b"\n")[0][0]
    h = np.where(digit & np.repeat(n >= params.min_tokens, n), field, h)
    place = np.arange(len(h)) - np.repeat(first, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_TURN, int(n.max(initial=0)))[place], dtype=np.uint64)])
    total, count = sums[first + n] - sums[first], n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    cuts = [first + np.minimum(params.depth, n) + np.maximum(n - params.depth, 0) * i // params.blocks for i in range(params.blocks + 1)]
    name = lambda h, sort: _mix(_mix(h + count) + np.uint64(sort)).view(np.int64)
    blocks = [name(total - (sums[b] - sums[a]), i + 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return line[first], name(total, 0), n >= params.general, np.stack(blocks, 1)


def _lines(docs: DataFrame, params: LineParams) -> DataFrame:
    """(row, doc, line, own, others) of every line with tokens: its own template and those with a variable block."""

    def run(batches):
        import pyarrow as pa

        from tabloom.llm._base import blocks, byte_texts

        for batch in batches:
            rows, ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), byte_texts(batch.column(2))
            for at, to in blocks(texts, 1 << 21):
                line, own, general, others = templates_of(b"".join(t + b"\n" for t in texts[at:to]), params)
                ends = np.cumsum([t.count(b"\n") + 1 for t in texts[at:to]])
                text = np.searchsorted(ends, line, "right")
                line = line - np.concatenate([[0], ends])[text]
                offsets = np.concatenate([[0], np.cumsum(general * params.blocks)]).astype(np.int32)
                columns = [pa.array(rows[at + text]), pa.array(ids[at + text]), pa.array(line.astype(np.int32)), pa.array(own), pa.ListArray.from_arrays(pa.array(offsets), pa.array(others[general].ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc", "line", "own", "others"])

    given = docs.select("row_", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "text").where("text IS NOT NULL")
    return map_arrow(given, run, "row long, doc long, line int, own long, others array<long>")


def _named(lines: DataFrame) -> DataFrame:
    """A row for each template of each line."""
    return lines.select("row", "doc", "line", "own", F.explode(F.concat(F.array("own"), "others")).alias("key"))


def _recurring(named: DataFrame, params: LineParams) -> DataFrame:
    """(key, first): templates that recur, and their first document."""
    ends = (F.min("own").alias("a"), F.max("own").alias("b"))
    if params.min_docs <= 2:
        found = named.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), *ends).where("first < last")
    else:
        per_doc = named.groupBy("key", "doc").agg(*ends)
        found = per_doc.groupBy("key").agg(F.min("doc").alias("first"), F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= params.min_docs)
    return found.where("a = key OR a <> b").select("key", "first")  # a whole line's template has a = b = key


def dedup(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """docs with text left without its dropped lines, and n_lines, dropped_lines (numbers from 0)."""
    docs = docs.drop("n_lines", "dropped_lines")
    renamed = plain(docs, "doc_id", "text")
    given = renamed.withColumn("row_", F.xxhash64("doc_id", "text"))
    named = _named(shared_table(_lines(given, params), "lines"))
    recurring = shared_table(_recurring(named, params), "templates")
    dropped = named.join(recurring, "key").where("doc > first").groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("dropped_"))
    joined = given.join(dropped, given["row_"] == dropped["row"], "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("dropped_", i)), "\n")
    none = F.col("dropped_").isNull()
    out = joined.select(*[F.when(none, F.col("text")).otherwise(kept).alias("text") if c == "text" else given[c] for c in renamed.columns], F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("dropped_", F.array()).cast("array<bigint>").alias("dropped_lines"))
    return out.toDF(*docs.columns, "n_lines", "dropped_lines")


def _show(line: bytes, key: int, params: LineParams) -> str:
    """The line's template of that name."""
    words = line.split()
    if len(words) >= params.min_tokens:
        words = [_FIELD if re.search(rb"[0-9]", w) else w for w in words]
        _, _, _, names = templates_of(line.replace(b"\n", b" ") + b"\n", params)
        for i in np.flatnonzero(names[0] == key):
            rest = len(words) - params.depth
            words[params.depth + rest * i // params.blocks : params.depth + rest * (i + 1) // params.blocks] = [_FIELD]
    return b" ".join(words).decode()


def templates(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """(first_doc, n_docs, n_lines, template) of every recurring template; variable fields are `<*>`."""
    given = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_"))
    named = _named(shared_table(_lines(given, params), "lines"))
    recurring = shared_table(_recurring(named, params), "templates")
    counted = named.groupBy("key", "doc").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("line").alias("line"))
    wide = counted.join(recurring, "key").groupBy("key", "first").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"))
    at = named.join(recurring, "key").where("doc = first").groupBy("key").agg(F.min(F.struct("row", "line")).alias("at")).select("key", "at.row", "at.line")
    texts = given.dropDuplicates(["row_"]).select(F.col("row_").alias("row"), F.split("text", "\n", -1).alias("parts"))
    shown = wide.join(at, "key").join(texts, "row").select("key", F.nullif("first", F.lit(_LAST)).alias("first_doc"), "n_docs", "n_lines", F.get("parts", F.col("line")).alias("template"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [_show(line.encode(), key, params) for key, line in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:4], pa.array(own, pa.string())], batch.schema.names[1:])

    return map_arrow(shown, run, "first_doc long, n_docs long, n_lines long, template string")


def query(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"), params)
    return out.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join("dropped_lines", ",").alias("dropped"), "text")
