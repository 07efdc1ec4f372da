"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprints of 64 bits are cut into three segments of 22, 21 and 21 bits, and each segment into three blocks. The
perfect binary Golay code (23, 12, distance 7) has one codeword within 3 bits of any segment; the codewords within 4
bits of a segment, at most six, include the one next to any segment that differs in one bit: where two segments differ
in one bit at most, one fingerprint's nearest codeword is among the other's nearby ones. By pigeonhole, 4 differing
bits lie in the segments in one of these ways, each with its own keys:

* two segments agree: both of them (42 bits or more);
* one agrees, the others differ in 2 bits each or less: that one, and a block of each of the others (35 or more);
* one agrees, another differs in 1 bit or less: that one and the other's codeword (33 or more);
* two differ in 1 bit or less, the third in 2 or less: two codewords and a block of the third (31 or more).

Candidates of a key are verified by their Hamming distance; of a key's links a spanning forest is kept, which has
the same components and stays linear however many fingerprints share the key.

Edge cases: a null text counts as empty; a text without words has fingerprint zero, and all such are linked; very
long texts are hashed whole; equal fingerprints (repeated rows included) are one node; rows of equal doc_id but unlike
texts are nodes of their own; a null doc_id never names a component unless all are null; a table without rows gives
none; columns other than doc_id and text, whatever their names, play no part.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm._base import map_arrow, plain, shared_table
from tabloom.llm._graph import components

#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
_GENERATOR = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of each 12-bit head, error pattern of each remainder, and for each remainder the changes to the
    codeword index that lead to all codewords within 4 bits, with how many there are."""
    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= _GENERATOR << (i - 11)
        return v

    head = np.array([remainder(m << 11) for m in range(4096)], np.int64)
    words = (np.arange(4096, dtype=np.int64) << 11) | head
    error = np.zeros(2048, np.int64)
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    for p in patterns:
        error[head[p >> 11] ^ (p & 0x7FF)] = p
    near, number = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for s in range(2048):
        close = words[(np.bitwise_count(words ^ error[s]) <= 4) & (words != 0)] >> 11
        number[s] = 1 + len(close)
        near[s, 1 : 1 + len(close)] = close
    return head, error, near, number


def decode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the codeword nearest to each segment, and the segment's remainder."""
    head, error, _, _ = golay()
    syndrome = head[v >> 11] ^ (v & 0x7FF)
    return (v ^ error[syndrome]) >> 11, syndrome


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Signed 64-bit SimHash of each text over XXH64 of its 4-word shingles."""
    import xxhash

    h = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= 4:
            out[k] = h(line, 42)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.diff(ends, prepend=0))[:-3].tolist()
        counts, n = np.zeros(64, np.int64), len(starts)
        stops = (ends[3:] - 1).tolist()
        for at in range(0, n, 1 << 14):
            hashes = np.array([h(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)])], np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def _blocks(i: int) -> list[tuple[int, int]]:
    """First bit and width of the blocks of segment i."""
    at, n = SEGMENTS[i]
    cuts = [at + (n * k + 2) // 3 for k in range(4)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row of fp, own): own marks keys under which a fingerprint is found, others only look."""
    _, _, near, number = golay()
    u, rows, every = fp.view(np.uint64), np.arange(len(fp)), np.ones(len(fp), bool)

    def bits(at: int, n: int) -> np.ndarray:
        return ((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)

    segments = [bits(*s) for s in SEGMENTS]
    blocks = [[bits(*x) for x in _blocks(i)] for i in range(3)]
    words = [decode(x) for x in segments]
    out: list = []
    family = 0

    def emit(key: np.ndarray, row: np.ndarray, own: np.ndarray) -> None:
        out.append(((np.int64(family) << 48) | key, row, own))

    for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        emit(segments[i] << 22 | segments[j], rows, every)
        family += 1
        for x in blocks[i]:
            for y in blocks[j]:
                emit(segments[k] << 16 | x << 8 | y, rows, every)
                family += 1
        (a, sa), (b, sb) = words[i], words[j]
        for (word, syndrome), same in (((a, sa), j), ((b, sb), i)):
            for x in range(6):
                ok = number[syndrome] > x
                emit(segments[same][ok] << 12 | (word ^ near[syndrome, x])[ok], rows[ok], np.full(int(ok.sum()), x == 0))
            family += 1
        for x in range(6):
            for y in range(6):
                ok = (number[sa] > x) & (number[sb] > y)
                pair, own = (a ^ near[sa, x])[ok] << 12 | (b ^ near[sb, y])[ok], np.full(int(ok.sum()), x == y == 0)
                for n, block in enumerate(blocks[k]):
                    out.append(((np.int64(family + n) << 48) | pair << 8 | block[ok], rows[ok], own))
        family += 3
    return tuple(np.concatenate(x) for x in zip(*out))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, since numpy counts those of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among distinct fingerprints; large sets are first cut by the value of each of
    five bit blocks, one of which any linked pair shares."""
    if len(fp) > 2048:
        out, cuts = [], (0, 13, 26, 39, 52, 64)
        for a, b in zip(cuts, cuts[1:]):
            part = (fp.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(part, kind="stable")
            for group in np.split(fp[order], np.flatnonzero(np.diff(part[order])) + 1):
                if len(group) > 1:
                    out += _grow(group)
        return out
    return _grow(fp)


def _grow(left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            f = queue.pop()
            near = distance(left, f) <= MAX_BITS
            if near.any():
                found = left[near]
                out.append((np.full(len(found), f), found))
                queue.extend(found)
                left = left[~near]
    return out


def _links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, small: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    sizes = np.diff(cuts, prepend=0, append=len(key))
    a, b = [], []
    of = np.repeat(sizes, sizes)
    few = (of > 1) & (of <= small)
    k, f, o = key[few], fp[few], own[few]
    for s in range(1, min(small, int(sizes[sizes <= small].max(initial=1)))):
        same = (k[s:] == k[:-s]) & (o[s:] | o[:-s]) & (distance(f[s:], f[:-s]) <= MAX_BITS)
        a.append(f[:-s][same])
        b.append(f[s:][same])
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > small):
        for x, y in forest(np.unique(fp[ends[i] - sizes[i] : ends[i]])):
            a.append(x)
            b.append(y)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    return pairs[:, pairs[0] != pairs[1]]


def _expand(batches):
    import pyarrow as pa

    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 1000):
            key, row, own = keys(fp[at : at + 1000])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at : at + 1000][row]), pa.array(own)], ["key", "fp", "own"])


def _match(batches):
    """Batches come sorted by key; a run that may go on in the next batch is held back."""
    import pyarrow as pa

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    waiting, pending = [], 0

    def emit(columns):
        a, b = _links(*columns)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    for batch in batches:
        waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        pending += batch.num_rows
        if pending < max(200_000, len(held[0])):  # so a long run is not copied for every batch
            continue
        held = [np.concatenate(x) for x in zip(held, *waiting)]
        waiting, pending = [], 0
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield emit([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    held = [np.concatenate(x) for x in zip(held, *waiting)] if waiting else held
    if len(held[0]) > 1:
        yield emit(held)


def _print(batches):
    import pyarrow as pa

    from tabloom.llm._base import byte_texts

    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fingerprints(byte_texts(batch.column(batch.num_columns - 1))))], [*batch.schema.names[:-1], "fp"])


def _prints(docs: DataFrame) -> DataFrame:
    """fp in place of text, which is the last column of docs."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema[:-1]), "fp long"])
    return shared_table(map_arrow(docs, _print, schema), "fingerprints")


def _rooted(first: DataFrame) -> DataFrame:
    """first (fp, ... one row for each fingerprint) with root, the least fingerprint that links lead to."""
    # Key bits are compared on both sides by value; keys are dealt and sorted by Spark, which spills.
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes become many: not to be coalesced
    given = first.select("fp").repartition(parts)
    dealt = map_arrow(given, _expand, "key long, fp long, own boolean").repartition("key").sortWithinPartitions("key")
    roots = components(map_arrow(dealt, _match, "u long, v long")).select(F.col("node").alias("fp"), "root")
    return first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint) and component_id of each row of docs (doc_id, text)."""
    prints = _prints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    named = _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # written, so that neither join below is tied to an aggregate and a large component or group of copies can be split
    least = shared_table(named.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    return prints.join(shared_table(named.join(least, "root").select("fp", "component_id"), "members"), "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the least doc_id, null ids last, of equal ids the least hash of the
    text; of rows that are equal in both the one of the least hash of its other columns."""
    renamed = plain(docs, "doc_id", "text")
    # 128 bits name a row by its id and text
    marked = renamed.withColumns({"a_": F.xxhash64("doc_id", "text"), "b_": F.xxhash64(F.lit(1), "doc_id", "text")})
    prints = _prints(marked.select(F.col("doc_id").cast("long").alias("doc_id"), "a_", "b_", "text"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "a_", "b_")
    named = _rooted(prints.groupBy("fp").agg(F.min(place).alias("first")))
    best = named.groupBy("root").agg(F.min("first").alias("best")).select("best.a_", "best.b_")
    others = [c for c in renamed.columns if c not in ("doc_id", "text") and "map<" not in renamed.schema[c].dataType.simpleString()]
    once = Window.partitionBy("a_", "b_").orderBy(F.xxhash64(F.lit(0), *others))
    kept = marked.join(shared_table(best, "kept"), ["a_", "b_"], "left_semi")
    return kept.withColumn("place_", F.row_number().over(once)).where("place_ = 1").select(*renamed.columns).toDF(*docs.columns)
