"""LM scoring: a log-bilinear neural model with noise-contrastive training, normalised by classes.

Items of the model are the end of text, the most frequent words, and buckets of all other words (by how they begin
and end); a bucket's words share its probability by their counts over all training documents, plus one for unseen
ones. The context is the sum of the last items' vectors, each scaled by its place. An item's probability is that of
its class times that within its class, each a softmax over at most `classes` entries, which batched matrix products
normalise. Training starts from a small warm-up model, goes over all training documents in every partition by
itself with shared noise classes and noise items of the class (NCE, Adagrad), and averages the partitions' models.

Counts cover all training documents and go through a shuffle of words; the most frequent words (at most `lookup`) are
broadcast, the tokens beyond them are joined with the counts.

Edge cases: null and empty texts are one end token; very long texts are scored whole; without training documents every
count is 0 and the model is uniform over its items; words of equal frequency rank in byte order, so the vocabulary does
not depend on the order of rows. Repeated rows are scored each; a table without rows gives none; columns other than
doc_id and text, whatever their names, are not looked at and are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import bounded_texts, chunks, fold, map_arrow, shared_table, split, training_sample


@dataclass(frozen=True)
class LMParams:
    """classes: classes, and items of a class; buckets: items for words beyond the vocabulary; lookup: most words
    that are broadcast, none over lookup_bytes bytes; dim, context: size and number of the context vectors; noise: noise samples of a token
    (classes, items); warm_docs, warm_bytes: bound of the warm-up sample, in rows and in bytes of their texts;
    warm_text_bytes: a longer text is represented in it by passages."""

    classes: int = 64
    buckets: int = 256
    lookup: int = 100_000
    lookup_bytes: int = 256
    dim: int = 16
    context: int = 3
    noise: tuple[int, int] = (16, 3)
    rate: float = 0.08
    batch: int = 4096
    warm_docs: int = 1000
    warm_bytes: int = 8_000_000
    warm_text_bytes: int = 100_000
    flush_words: int = 600_000
    flush_bytes: int = 1 << 26


def _bucket(word: bytes, params: LMParams) -> int:
    """Item of a word that is not in the vocabulary."""
    return params.classes**2 - params.buckets + zlib.crc32(word[:2] + word[-2:]) % params.buckets


@cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC32 of one byte twice; what the first two and the last two of four bytes give, to be joined by XOR."""
    pairs = [v.to_bytes(2, "little") for v in range(1 << 16)]
    zero = zlib.crc32(bytes(4))
    one = [zlib.crc32(bytes([v, v])) for v in range(256)]
    return np.array(one), np.array([zlib.crc32(p + bytes(2)) ^ zero for p in pairs]), np.array([zlib.crc32(bytes(2) + p) for p in pairs])


def _buckets(words, params: LMParams) -> np.ndarray:
    """_bucket of each word, none empty, of an Arrow binary array."""
    if not len(words):
        return np.zeros(0, np.int64)
    one, head, tail = _crc_tables()
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8).astype(np.int64)
    begin, end = offsets[:-1], offsets[1:]
    single = end - begin == 1
    second, last = np.where(single, begin, begin + 1), end - 1
    crc = head[data[begin] | data[second] << 8] ^ tail[data[np.where(single, begin, end - 2)] | data[last] << 8]
    crc[single] = one[data[begin[single]]]
    return params.classes**2 - params.buckets + crc % params.buckets


class LogBilinear:
    """r: context vectors, c: scale of each place; q, b: item vectors and biases; qc, bc: those of classes.
    Item i is of class i % classes, so that frequent items spread over all classes."""

    def __init__(self, p: np.ndarray, params: LMParams):
        """p: probability of each item."""
        self.params = params
        n, k, d = params.classes**2, params.classes, params.dim
        rng = np.random.default_rng(5)
        self.p = np.maximum(p, 1e-9)
        self.pc = self.p.reshape(-1, k).sum(0)
        self.within = self.p / self.pc[np.arange(n) % k]
        # log of the expected number of times that noise draws each class, each item
        self.noise_class = np.log(params.noise[0] * self.pc).astype(np.float32)
        self.noise_item = np.log(params.noise[1] * self.within).astype(np.float32)
        self.w = {
            "r": rng.normal(0, 0.1, (n, d)).astype(np.float32), "c": np.ones((params.context, d), np.float32),
            "q": rng.normal(0, 0.1, (n, d)).astype(np.float32), "b": np.log(self.within).astype(np.float32)[:, None],
            "qc": rng.normal(0, 0.1, (k, d)).astype(np.float32), "bc": np.log(self.pc).astype(np.float32)[:, None],
        }
        self.seen = {name: np.full((len(v), 1), 1e-2, np.float32) for name, v in self.w.items()}
        self.keep, self.other = _alias(self.within.reshape(-1, k))
        self.rng = rng

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """Items before each position; every text ends with item 0, which also stands before its beginning."""
        out = np.zeros((self.params.context, len(ids)), np.int64)
        alive = np.ones(len(ids), bool)
        for j in range(self.params.context):
            back = np.concatenate([np.zeros(j + 1, np.int64), ids[: len(ids) - j - 1]])[: len(ids)]
            out[j] = np.where(alive, back, 0)
            alive &= back != 0
        return out

    def hidden(self, x: np.ndarray) -> np.ndarray:
        k = self.params.classes  # rows of the whole table are scaled k at a time, as short rows are slow one by one
        return sum((self.w["r"].reshape(k, -1) * np.tile(self.w["c"][j], k)).reshape(self.w["r"].shape).take(x[j], axis=0) for j in range(len(x)))

    def _move(self, **grads: np.ndarray) -> None:
        """Adagrad steps of the named parameters by their gradients, columns by rows of the parameter; rows without a
        gradient stay as they are."""
        for name, g in grads.items():
            self.seen[name] += (g * g).mean(0)[:, None]
            self.w[name] -= (g * (self.params.rate / np.sqrt(self.seen[name][:, 0]))).T

    def train(self, ids: np.ndarray) -> None:
        """One pass over texts laid end to end."""
        contexts = self.contexts(ids)
        for at in range(0, len(ids), self.params.batch):
            self._step(contexts[:, at : at + self.params.batch], ids[at : at + self.params.batch])

    def _step(self, x: np.ndarray, y: np.ndarray) -> None:
        w, k, (nc, ni), n, size = self.w, self.params.classes, self.params.noise, len(y), len(self.p)
        h, cls = self.hidden(x), y % k
        drawn = np.searchsorted(np.cumsum(self.pc), self.rng.random(nc) * self.pc.sum()).clip(0, k - 1)
        class_bias, bias = w["bc"][:, 0] - self.noise_class, w["b"][:, 0] - self.noise_item
        qc, qd = w["qc"].take(cls, axis=0), w["qc"][drawn]
        own = _sigmoid(np.einsum("nd,nd->n", h, qc) + class_bias.take(cls)) - 1
        other = _sigmoid(h @ qd.T + class_bias[drawn])
        noise = self.rng.integers(0, size // k, (ni, n)) * k + cls
        noise = np.where(self.rng.random((ni, n), np.float32) < self.keep.take(noise), noise, self.other.take(noise))
        items = np.concatenate([y[None], noise])
        qi = w["q"].take(items, axis=0)
        g = _sigmoid(np.einsum("snd,nd->sn", qi, h) + bias.take(items))
        g[0] -= 1
        dh = np.einsum("n,nd->nd", own, qc) + other @ qd + np.einsum("sn,snd->nd", g, qi)
        columns, items = np.ascontiguousarray(h.T), items.ravel()
        dq = _sums(items, ((g * v).ravel() for v in columns), size)
        dqc = _sums(cls, (own * v for v in columns), k)
        np.add.at(dqc.T, drawn, other.T @ h)
        dbc = np.bincount(cls, own, k) + np.bincount(drawn, other.sum(0), k)
        places = (x + np.arange(len(x))[:, None] * size).ravel()
        by_place = _sums(places, (np.tile(v, len(x)) for v in np.ascontiguousarray(dh.T)), size * len(x)).reshape(-1, len(x), size)
        dr = np.einsum("djr,jd->dr", by_place, w["c"])
        dc = np.einsum("djr,dr->dj", by_place, np.ascontiguousarray(w["r"].T)) / n
        self._move(q=dq, b=np.bincount(items, g.ravel(), size).astype(np.float32)[None])
        self._move(qc=dqc, bc=dbc.astype(np.float32)[None], r=dr, c=dc)

    def log10(self, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each item given those before it."""
        w, k = self.w, self.params.classes
        out = np.empty(len(ids))
        contexts = self.contexts(ids)
        per = len(self.p) // k
        for at in range(0, len(ids), 1 << 16):
            y = ids[at : at + (1 << 16)]
            h, cls = self.hidden(contexts[:, at : at + (1 << 16)]), y % k
            lp = np.empty(len(y), np.float32)
            for i in range(0, len(y), 1 << 12):
                lp[i : i + (1 << 12)] = _log_softmax(h[i : i + (1 << 12)], w["qc"], w["bc"][:, 0], cls[i : i + (1 << 12)])
            order = np.argsort(cls, kind="stable")
            ends = np.cumsum(np.bincount(cls, minlength=k))
            for c in np.flatnonzero(np.diff(ends, prepend=0)):
                rows = order[ends[c - 1] if c else 0 : ends[c]]
                lp[rows] += _log_softmax(h.take(rows, axis=0), w["q"][c::k], w["b"][c::k, 0], y[rows] // k)
            out[at : at + len(y)] = lp / np.log(10)
        assert per * k == len(self.p)
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, v in self.w.items():
            self.w[name] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def _sums(index: np.ndarray, columns: Iterable[np.ndarray], size: int) -> np.ndarray:
    """Sums of each column over the places that index gives a row: columns by rows. No sort and no gather is needed."""
    return np.array([np.bincount(index, v, size) for v in columns], np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -30, 30)
    np.exp(np.negative(z, out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _log_softmax(h: np.ndarray, q: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of entry `at` of each row."""
    z = h @ q.T
    z += b
    top = z.max()
    if not top - z.min() < 80:  # one shift for all rows would underflow
        top = z.max(1, keepdims=True)
    z -= top
    own = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], z.dtype))


def _alias(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alias tables (Walker) to draw rows of each column of p in constant time: (share kept, index drawn instead),
    both by row * columns + column."""
    n, k = p.shape
    keep, other = np.ones((n, k), np.float32), np.arange(n * k).reshape(n, k)
    for c in range(k):
        rest = p[:, c] / p[:, c].sum() * n
        small, large = np.flatnonzero(rest < 1).tolist(), np.flatnonzero(rest >= 1).tolist()
        while small and large:
            i, j = small.pop(), large[-1]
            keep[i, c], other[i, c] = rest[i], j * k + c
            rest[j] -= 1 - rest[i]
            if rest[j] < 1:
                small.append(large.pop())
    return keep.ravel(), other.ravel()


class Lexicon:
    """Frequent words with their counts and items."""

    def __init__(self, frequent: list[tuple[bytes, int]], params: LMParams):
        import pyarrow as pa

        self.params = params
        self.words = pa.array([w for w, _ in frequent], pa.binary())
        self.count = np.array([n for _, n in frequent], np.float64)
        named = params.classes**2 - params.buckets - 1
        self.items = np.array([i + 1 if i < named else _bucket(w, params) for i, (w, _) in enumerate(frequent)], np.int64)
        self.named = min(named, len(frequent))

    def find(self, words) -> np.ndarray:
        """Number of each word of an Arrow binary array, -1 if it is not frequent."""
        import pyarrow.compute as pc

        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def read(self, column) -> tuple[np.ndarray, object, np.ndarray, np.ndarray]:
        """(words of each text, all words, their numbers, items of all tokens) of texts laid end to end; an end
        follows each text."""
        lengths, words = split(column)
        number = self.find(words)
        items = self.items[number] if len(self.items) else np.zeros(len(number), np.int64)
        rare = np.flatnonzero(number < 0)
        items[rare] = _buckets(words.take(rare), self.params)
        return lengths, words, number, np.insert(items, np.cumsum(lengths), 0)


def _merged(held: list[tuple]) -> tuple:
    """(words, their counts) of several such pairs, each word once."""
    import pyarrow as pa

    words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
    return words.dictionary, np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in held]), len(words.dictionary)).astype(np.int64)


def count_words(training: DataFrame, params: LMParams) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, size = [], 0  # words and counts of chunks, and their number with repeats
        seen = 0  # bytes of texts since the last table
        for batch in batches:
            for part in chunks(batch.column(0)):
                words = split(part)[1]
                held.append(_merged([(words, np.ones(len(words)))]))
                size += len(held[-1][1])
                seen += pc.sum(pc.binary_length(part)).as_py() or 0
                if size > 2 * params.flush_words or seen > params.flush_bytes:
                    held = [_merged(held)]
                    size = len(held[0][1])
                    if size > params.flush_words or seen > params.flush_bytes:
                        yield pa.RecordBatch.from_arrays([held[0][0], pa.array(held[0][1])], ["word", "n"])
                        held, size, seen = [], 0, 0
        if held:
            words, n = _merged(held)
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])

    return map_arrow(training.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _by_text(words, cut: np.ndarray):
    """List array of each text's different words with their counts; words lie end to end, text k from cut[k] on."""
    import pyarrow as pa

    found = words.dictionary_encode()
    size = max(1, len(found.dictionary))
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    pairs, n = np.unique(text * size + found.indices.to_numpy(), return_counts=True)
    items = pa.StructArray.from_arrays([found.dictionary.take(pa.array(pairs % size)), pa.array(n.astype(np.int64))], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(cut)) * size).astype(np.int32)), items)


def _bucket_sums(counts: DataFrame, lexicon, params: LMParams) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each bucket."""

    def run(batches):
        import pyarrow as pa

        first = params.classes**2 - params.buckets
        total, distinct = np.zeros(params.buckets, np.int64), np.zeros(params.buckets, np.int64)
        known = lexicon.value
        for batch in batches:
            number = known.find(batch.column(0))
            beyond = np.flatnonzero((number < 0) | (number >= known.named))
            k = _buckets(batch.column(0).take(beyond), params) - first
            np.add.at(total, k, batch.column(1).to_numpy()[beyond])
            np.add.at(distinct, k, 1)
        some = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(distinct[some])], ["bucket", "n", "words"])

    rows = counts.mapInArrow(run, "bucket long, n long, words long").groupBy("bucket").agg(F.sum("n"), F.sum("words")).collect()
    total, distinct = np.zeros(params.buckets), np.zeros(params.buckets)
    for k, n, words in rows:
        total[k], distinct[k] = n, words
    return total, distinct


def _short(params: LMParams):
    """Of words that may be broadcast."""
    return F.octet_length("word") <= params.lookup_bytes


def fit(training: DataFrame, params: LMParams):
    """(counts table, broadcast lexicon, broadcast model, N, V, texts, log10 of each bucket's own denominator)."""
    spark = training.sparkSession
    counts = shared_table(count_words(training, params), "word-counts")
    docs = training.count()
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("n"))
    held, total, distinct, least = 0, docs, int(docs > 0), None
    for r in levels.toLocalIterator():  # one row for each different count
        total, distinct = total + r["tokens"], distinct + r["words"]
        if held is not None and held + r["words"] <= params.lookup:
            held, least = held + r["words"], r["n"]
        else:
            held = None
    frequent = counts.where((F.col("n") >= (least or 0)) & _short(params)).collect() if least is not None else []
    frequent = sorted(((bytes(r[0]), r[1]) for r in frequent), key=lambda x: (-x[1], x[0]))
    lexicon = Lexicon(frequent, params)
    shared = spark.sparkContext.broadcast(lexicon)
    bucket_n, bucket_words = _bucket_sums(counts, shared, params)
    n = params.classes**2
    p = np.zeros(n)
    p[0] = docs + 1
    p[1 : 1 + lexicon.named] = lexicon.count[: lexicon.named]
    p[n - params.buckets :] = bucket_n + 1
    p += 0.1
    model = LogBilinear(p / p.sum(), params)
    if docs:
        drawn = bounded_texts(training_sample(training, params.warm_docs).where("text IS NOT NULL"), params.warm_text_bytes, params.warm_bytes)
        warm = [r[0] for r in drawn.orderBy("doc_id", F.xxhash64("text")).select("text").collect()]
        if warm:
            import pyarrow as pa

            model.train(lexicon.read(pa.array(warm, pa.string()))[3])
        model = _refine(training, shared, model, params)
    return counts, shared, spark.sparkContext.broadcast(model), total, distinct, docs, np.log10(bucket_n + bucket_words + 1), least


def _refine(training: DataFrame, lexicon, model: LogBilinear, params: LMParams) -> LogBilinear:
    """Trains in every partition on all its texts; averages by tokens. Parameters travel in pieces that are added up
    as they stream, so no task or driver holds more than two models."""
    spark = training.sparkSession
    start = spark.sparkContext.broadcast(model)
    pieces = 32

    def train(batches):
        import copy

        import pyarrow as pa

        own, seen = copy.deepcopy(start.value), 0
        for batch in batches:
            for part in chunks(batch.column(0)):
                items = lexicon.value.read(part)[3]
                own.train(items)
                seen += len(items)
        if seen:
            for i, part in enumerate(np.array_split(own.flat(), pieces)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([seen], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["piece", "weight", "values"])

    def add(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                part = np.frombuffer(row["values"], np.float32).astype(np.float64) * row["weight"]
                n, s = sums.get(row["piece"], (0, 0.0))
                sums[row["piece"]] = n + row["weight"], s + part
        for i, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([(s / n).astype(np.float32).tobytes()], pa.binary())], ["piece", "weight", "values"])

    schema = "piece int, weight long, values binary"
    rows = map_arrow(training.select("text"), train, schema).repartition(pieces, "piece").mapInArrow(add, schema).collect()
    if rows:
        model.load(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])]))
    return model


def score(docs: DataFrame, training: DataFrame, params: LMParams = LMParams()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    counts, lexicon, model, n_all, n_words, n_docs, shares, least = fit(training.select("doc_id", "text"), params)
    floor = float(np.log10(n_all + n_words + 1))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        lex, lm, part, row = lexicon.value, model.value, TaskContext.get().partitionId(), 0
        logs = np.log10(lex.count + 1)
        first = params.classes**2 - params.buckets
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in chunks(batch.column(1)):
                lengths, words, number, items = lex.read(texts)
                lp = lm.log10(items)
                ends = np.cumsum(lengths)
                flat = np.where(number >= 0, logs[number] if len(logs) else 0.0, 0.0)
                own = np.delete(items, ends + np.arange(len(ends)))
                inner = own >= first
                extra = np.where(inner, flat - shares[np.where(inner, own - first, 0)], 0.0)
                unknown = np.flatnonzero(number < 0)
                cut = np.searchsorted(unknown, [0, *ends])
                rare, known = _by_text(words.take(unknown), cut), (lengths - np.diff(cut) + int(n_docs > 0)).tolist()
                out = {k: [] for k in ("row", "doc_id", "n_tokens", "n_known", "base", "score")}
                begin = 0
                for k, end in enumerate(ends.tolist()):
                    size = end - begin
                    out["row"].append((part << 36) + row)
                    out["doc_id"].append(ids[at + k])
                    out["n_tokens"].append(size + 1)
                    out["n_known"].append(known[k])
                    out["base"].append(float(flat[begin:end].sum() + np.log10(n_docs + 1) - (size + 1) * floor))
                    out["score"].append(float(lp[begin + k : end + k + 1].sum() + extra[begin:end].sum()))
                    begin, row = end, row + 1
                at += len(texts)
                kinds = [pa.int64()] * 4 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(out.values(), kinds)), rare], [*out, "rare"])

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:bigint>>"
    scored = shared_table(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema), "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("times"))
    below = counts if least is None else counts.where((F.col("n") < least) | ~_short(params))
    joined = rare.join(below, "word").groupBy("row").agg(F.sum("times").alias("known_"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_"))
    out = scored.drop("rare").join(joined, "row", "left")
    more = F.coalesce("more_", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known_", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def query(docs: DataFrame, params: LMParams = LMParams()) -> DataFrame:
    held = fold(F.col("doc_id"), 7) == 2
    out = score(docs, docs.where(~held), params)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
