"""Benchmark decontamination by an FM-index per training shard.

A shard's words become symbols (a word that no test phrase has is a separator), its suffixes are sorted, and the
Burrows-Wheeler transform goes into a wavelet matrix. Test phrases are searched backward through rank queries, all
at once; occurrences are located by walking to sampled suffix positions, and become merged removal spans.

Stretches of words that are shorter than every test phrase can hold no occurrence and are left out of the index.

Edge cases: null and empty texts have no words; an item without words has no phrase; items of one id count as one
item, and a phrase of several items counts for each; a document longer than a shard is indexed in pieces that overlap
by one word less than the longest phrase, so very long texts are searched whole; repeated rows get equal results; an
empty benchmark leaves every document clean, and a table without rows gives none. A benchmark over block_words is
searched block by block. Columns of any other name stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import map_arrow, plain

#: Lower-cases A-Z, blanks what is not [0-9a-z] or beyond ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class DecontaminationParams:
    """width: words of a phrase; shard_words: words of an index; sample: every so many-th suffix position is kept;
    block_words: words of benchmark text that are broadcast at once."""

    width: int = 10
    shard_words: int = 1 << 19
    sample: int = 8
    block_words: int = 500_000


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        """text: symbols from 0 to symbols - 1, where 0 separates and never matches; it ends with 0."""
        n = len(text)
        sa = self._suffixes(text, symbols)
        before = text[sa - 1]
        before[sa == 0] = 0
        self.bwt = before
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        kept = (sa % sample == 0) | (before == 0)  # a walk never has to cross a separator
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.kept, self.samples = kept, sa[kept].astype(np.int32)
        self.levels, row = [], before
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            one = (row >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)]).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            row = np.concatenate([row[~one], row[one]])
        self.base = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))
        self.n = n

    @staticmethod
    def _suffixes(text: np.ndarray, symbols: int) -> np.ndarray:
        """Positions by suffix; each separator is a symbol of its own, so comparisons end there."""
        n = len(text)
        gaps = text == 0
        number = np.cumsum(gaps) - 1
        width = n.bit_length()
        reach, todo, at = 1, np.flatnonzero(~gaps), np.flatnonzero(gaps)
        per = max(2, 63 // width)
        out = np.empty(n, np.int64)
        out[: len(at)] = at
        # rank: place of the first of its group in sorted order
        rank = np.where(gaps, number, int(gaps.sum()) + np.concatenate([[0], np.cumsum(np.bincount(text[~gaps], minlength=symbols))])[text])
        while len(todo):
            key = rank[todo]
            for i in range(1, per):
                ahead = todo + i * reach
                key = (key << width) | np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
            order = np.argsort(key)
            todo, key = todo[order], key[order]
            new = np.empty(len(key), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            # a group's members keep their old group's place plus their offset in it
            group = rank[todo]
            old = np.empty(len(key), bool)
            old[0] = True
            np.not_equal(group[1:], group[:-1], out=old[1:])
            index = np.arange(len(key))
            place = group + index - np.maximum.accumulate(np.where(old, index, 0))
            first = place[np.maximum.accumulate(np.where(new, index, 0))]
            rank[todo] = first
            alone = new & np.append(new[1:], True)
            out[place[alone]] = todo[alone]
            todo, reach = todo[~alone], reach * per
        return out

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, zeros, total in self.levels:
            z = zeros[i]
            i = np.where(c >> bit & 1, total + i - z, z)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Row of the suffix that begins with c before row i's suffix."""
        return self.counts[c] + self._descend(c, i) - self.base[c]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (rows padded at the left; lengths symbols each)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((low < high) & (phrases.shape[1] - k <= lengths))
            if len(on):
                c = phrases[on, k]
                both = self.step(np.concatenate([c, c]), np.concatenate([low[on], high[on]]))
                low[on], high[on] = both[: len(on)], both[len(on) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked = np.empty(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.kept[rows]
            out[todo[done]] = self.samples[self.kept_rank[rows[done]]] + walked
            todo, rows = todo[~done], rows[~done]
            rows, walked = self.step(self.bwt[rows], rows), walked + 1
        return out


class Phrases:
    """Distinct phrases of benchmark items as symbol rows, with the items that have them."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.width, self.vocabulary, found = width, {}, {}
        for item, text in items:
            own = words(text)
            for word in own:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
            for i in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(tuple(self.vocabulary[w] for w in own[i : i + width]), set()).add(item)
        self.items = [sorted(x, key=lambda v: (v is None, v)) for x in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.array([(0,) * (width - len(p)) + p for p in found], np.int64).reshape(-1, width)


def scan(texts: list[bytes], phrases: Phrases, params: DecontaminationParams) -> list[tuple[int, list[tuple[int, int]], set]]:
    """(words, merged word spans, items) of each text."""
    numbers, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    get, over = phrases.vocabulary.get, params.width - 1
    shard, owners, total = [], [], 0
    for k, text in enumerate(texts):
        own = words(text)
        numbers[k] = len(own)
        if not len(phrases.rows):
            continue
        ids = np.fromiter(map(get, own, repeat(0)), np.int64, len(own))
        for at in range(0, max(1, len(own) - over), params.shard_words):
            piece = ids[at : at + params.shard_words + over]
            shard.append(piece)
            owners.append((k, at))
            total += len(piece)
            if total >= params.shard_words:
                _search(shard, owners, phrases, params, spans, items)
                shard, owners, total = [], [], 0
    if total:
        _search(shard, owners, phrases, params, spans, items)
    return [(n, _merge(s), i) for n, s, i in zip(numbers, spans, items)]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(shard: list[np.ndarray], owners: list[tuple[int, int]], phrases: Phrases, params: DecontaminationParams, spans: list, items: list) -> None:
    gap = np.zeros(1, np.int64)
    ids = np.concatenate([gap, *(x for piece in shard for x in (piece, gap))])
    starts = 1 + np.cumsum([0, *(len(p) + 1 for p in shard[:-1])])
    zero = ids == 0
    edges = np.flatnonzero(np.diff(zero))  # a run of known words lies between two of these
    begin, end = edges[::2] + 1, edges[1::2] + 1
    long = end - begin >= phrases.lengths.min()
    begin, end = begin[long], end[long]
    if not len(begin):
        return
    keep = np.zeros(len(ids) + 1, np.int8)
    keep[begin] += 1
    keep[np.minimum(end + 1, len(ids))] -= 1  # with the separator behind
    place = np.flatnonzero(np.cumsum(keep[:-1]))
    index = FMIndex(ids[place], len(phrases.vocabulary) + 1, params.sample)
    low, high = index.search(phrases.rows, phrases.lengths)
    hit = np.flatnonzero(low < high)
    for some in np.array_split(hit, max(1, int((high - low)[hit].sum()) >> 20)):
        n = (high - low)[some]
        which = np.repeat(some, n)
        at = place[index.locate(np.arange(int(n.sum())) + np.repeat(low[some] - (np.cumsum(n) - n), n))]
        piece = np.searchsorted(starts, at, "right") - 1
        marks = np.unique(np.stack([piece, at - starts[piece], which]), axis=1)
        for p, a, w in marks.T.tolist():
            k, offset = owners[p]
            own, begin_at, end_at = spans[k], a + offset, a + offset + int(phrases.lengths[w])
            if own and own[-1][0] <= begin_at <= own[-1][1]:
                own[-1] = (own[-1][0], max(end_at, own[-1][1]))
            else:
                own.append((begin_at, end_at))
            items[k].update(phrases.items[w])


def find(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """docs' columns with n_words, removal_spans (in words, merged) and item_ids (occurring items, distinct).

    Columns of docs that have one of these names are replaced.
    """
    docs = docs.drop("n_words", "removal_spans", "item_ids")
    spark = docs.sparkSession
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "removal_spans": F.lit(None).cast(_SPANS), "item_ids": F.lit(None).cast("array<bigint>")})
    given = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / (6 * params.block_words)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    place = docs.columns.index("text")
    for part in range(parts):
        block = given if parts == 1 else given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        phrases = spark.sparkContext.broadcast(Phrases([(r[0], r[1].encode()) for r in block.collect()], params.width))

        def run(batches, phrases=phrases):
            import pyarrow as pa

            from tabloom.llm._base import byte_texts

            for batch in batches:
                found = scan(byte_texts(batch.column(place)), phrases.value, params)
                old_s, old_i = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                spans = [[{"start": a, "end": b} for a, b in _merge([*((x["start"], x["end"]) for x in o or []), *s])] for o, (_, s, _) in zip(old_s, found)]
                ids = [sorted({*(o or []), *i}, key=lambda v: (v is None, v)) for o, (_, _, i) in zip(old_i, found)]
                columns = [*batch.columns[:-3], pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(ids, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        out = map_arrow(out, run, schema)
    return out


def query(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    found = find(docs.select("doc_id", "text"), benchmark, params)
    hit = F.aggregate("removal_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """docs without the documents that hold a phrase of the benchmark."""
    renamed = plain(docs, "doc_id", "text")
    return find(renamed, benchmark, params).where(F.size("removal_spans") == 0).select(*renamed.columns).toDF(*docs.columns)
