"""Toxicity: a two-state linear-chain CRF tags toxic spans; forward-backward marginals make document scores.

Labels are given for documents only. Token labels come from them: words whose presence speaks clearly for the
toxic label (one-sided bound of the log odds), each counted once per different passage around it, so that copied
passages do not speak many times, are the labelled tokens of toxic documents; the CRF learns
emission and transition weights from windows that cover all of them and from windows of other text; a text shorter
than a window is one window. Near copies in the sample share the weight of one text. A logistic layer over
the marginals (highest marginal, expected number of toxic tokens) maps them to the label's probability.

Edge cases: null and empty texts have no token and get the base score; very long texts are scored whole, in blocks of
texts; repeated rows get equal scores; repeated labels of one document count as toxic if any says so; with no labelled
rows, or only one class, the score is the share of toxic labels (0 if none); words of equal frequency enter the
vocabulary in byte order; a table without rows gives none; other columns, also of the names used here, stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import blocks, bounded_texts, fold, map_arrow, plain, training_sample

#: Lower-cases A-Z and blanks other ASCII than letters, digits and apostrophes.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


@dataclass(frozen=True)
class ToxicityParams:
    """sample_rows, sample_bytes: bound of the labelled sample, in rows and in bytes of their texts;
    sample_text_bytes: a longer text is represented by passages of it; vocabulary: words with an emission weight;
    window: tokens of a training window; block_tokens: tokens tagged at once, unless one text has more."""

    sample_rows: int = 6000
    sample_bytes: int = 48_000_000
    sample_text_bytes: int = 1_000_000
    vocabulary: int = 1 << 14
    min_docs: int = 4
    seed_log_odds: float = 3.0
    window: int = 24
    steps: int = 150
    block_tokens: int = 1 << 18


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _sketch(words: list[bytes]) -> int:
    """A minimum hash over word triples: near copies in the sample mostly share it and then share one text's weight."""
    return min((hash_(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def hash_(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, 42)


class ToxicCRF:
    """State 1 is toxic. emission: log potential of state 1 over state 0 by word; a: transition potentials."""

    def __init__(self, words: dict[bytes, int], emission: np.ndarray, a: np.ndarray, start: float, head: np.ndarray, params: ToxicityParams):
        self.words, self.emission, self.a, self.start, self.head, self.params = words, emission, a, start, head, params

    def marginals(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(state 1) of each token of many documents laid end to end; first: whether a token starts a document.

        Ratios of forward and backward messages follow Moebius maps, so pieces of the chain ("lanes") run side by
        side: one pass composes each lane's map, a second runs through it from its true beginning.
        """
        n = len(ids)
        if not n:
            return np.zeros(0)
        lanes = max(1, int(n**0.5))
        steps = -(-n // lanes)
        w, s = np.ones(lanes * steps), np.ones(lanes * steps, bool)
        w[:n], s[:n] = np.exp(self.emission[ids]), first
        forward = self._run(w.reshape(lanes, steps).T, s.reshape(lanes, steps).T, ahead=True)
        ahead_w = np.append(w[1:], 1.0)[::-1]
        ahead_s = np.append(s[1:], True)[::-1]
        back = self._run(ahead_w.reshape(lanes, steps).T, ahead_s.reshape(lanes, steps).T, ahead=False)
        odds = forward.T.ravel()[:n] * back.T.ravel()[::-1][:n]
        return odds / (1 + odds)

    def _run(self, w: np.ndarray, s: np.ndarray, ahead: bool) -> np.ndarray:
        (a00, a01), (a10, a11) = self.a
        if ahead:  # r' = w (a01 + a11 r) / (a00 + a10 r); at a start w * start
            m = (np.where(s, 0, w * a11), w * np.where(s, self.start, a01), np.where(s, 0.0, a10), np.where(s, 1.0, a00))
        else:  # q' = (a10 + a11 w q) / (a00 + a01 w q); before a start 1
            m = (np.where(s, 0, w * a11), np.where(s, 1.0, a10), np.where(s, 0, w * a01), np.where(s, 1.0, a00))
        steps, lanes = w.shape
        p, q, u, v = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
        for t in range(steps):
            b, c, d, e = (x[t] for x in m)
            p, q, u, v = b * p + c * u, b * q + c * v, d * p + e * u, d * q + e * v
            scale = np.maximum(np.maximum(p, q), np.maximum(u, v))
            p, q, u, v = p / scale, q / scale, u / scale, v / scale
        r = np.ones(lanes)
        for k in range(1, lanes):
            r[k] = (p[k - 1] * r[k - 1] + q[k - 1]) / (u[k - 1] * r[k - 1] + v[k - 1])
        out = np.empty_like(w)
        for t in range(steps):
            b, c, d, e = (x[t] for x in m)
            r = np.clip((b * r + c) / (d * r + e), 1e-30, 1e30)
            out[t] = r
        return out

    def tag(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Marginals of the tokens of each whole text; no more than a block of texts is held as tokens."""
        at = 0
        while at < len(texts):
            parts, total = [], 0
            while at < len(texts) and (not parts or total < self.params.block_tokens):
                parts.append(tokens(texts[at]))
                total += len(parts[-1])
                at += 1
            get = self.words.get
            yield from zip(self.split_marginals([np.fromiter((get(t, 0) for t in x), np.int64, len(x)) for x in parts]), parts)

    def split_marginals(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of each of some texts, given as word numbers."""
        lengths = np.array([len(x) for x in texts])
        first = np.zeros(int(lengths.sum()), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        return np.split(self.marginals(np.concatenate(texts), first), np.cumsum(lengths)[:-1])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([[1.0, m.max(initial=0.0), np.log1p(m.sum())] for m, _ in self.tag(texts)]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.head, -30, 30)))

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Byte ranges of the runs of tokens that are toxic rather than not."""
        (m, parts), out, at = next(self.tag([text])), [], 0
        folded = text.translate(_FOLD)
        for p, word in zip(m, parts):
            begin = folded.index(word, at)
            at = begin + len(word)
            if p > 0.5:
                if out and not folded[out[-1][1] : begin].strip():
                    out[-1] = (out[-1][0], at)
                else:
                    out.append((begin, at))
        return out


def fit(rows: Iterable[tuple[int, bytes]], params: ToxicityParams) -> ToxicCRF | float:
    """rows: (label, text). A constant where there is nothing to tell classes apart."""
    index: dict[bytes, int] = {}
    kept, groups = [], {}
    for label, text in rows:
        words = tokens(text)
        group = groups.setdefault((_sketch(words), label) if words else len(kept), [])
        group.append(len(kept))
        kept.append((label, np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))))
    y, weight = np.array([label for label, _ in kept]), np.ones(len(kept))
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    for group in groups.values():
        weight[group] = 1 / len(group)
    docs, found = np.zeros((2, len(index))), np.zeros(len(index), np.int64)
    for (label, doc), w in zip(kept, weight):
        own = np.unique(doc)
        docs[label, own] += w
        found[own] += 1
    docs[1] = np.minimum(docs[1], _passages([doc for label, doc in kept if label], len(index)))
    clean, toxic = docs + 0.5
    odds = np.log(toxic / (weight[y == 1].sum() + 1)) - np.log(clean / (weight[y == 0].sum() + 1)) - np.sqrt(1 / toxic + 1 / clean)
    seed = (docs[1] >= params.min_docs - 1e-6) & (odds > params.seed_log_odds)
    names = list(index)
    seeds = sorted(np.flatnonzero(seed).tolist(), key=names.__getitem__)
    frequent = sorted(np.flatnonzero((found >= params.min_docs) & ~seed).tolist(), key=lambda i: (-found[i], names[i]))
    vocabulary = [*seeds, *frequent][: params.vocabulary]
    item = np.zeros(len(index), np.int64)
    item[vocabulary] = np.arange(1, len(vocabulary) + 1)
    words = {names[i]: k for k, i in enumerate(vocabulary, 1)}
    del names, index
    rng, windows = np.random.default_rng(11), []
    for (label, doc), w in zip(kept, weight):
        if not len(doc):
            continue
        last, until = max(0, len(doc) - params.window), -1
        for c in [*(np.flatnonzero(seed[doc]).tolist() if label else []), int(rng.integers(0, len(doc)))]:
            if c >= until or c < until - params.window:  # not within the window before
                at = min(max(0, c - params.window // 2), last)
                own, until = doc[at : at + params.window], at + params.window
                windows.append((item[own], seed[own] * label, w))
    emission, a, start = _train(windows, len(words) + 1, params.steps)
    crf = ToxicCRF(words, emission, a, start, np.zeros(3), params)
    x = np.ones((len(kept), 3))
    for at, to in blocks([doc for _, doc in kept], params.block_tokens):
        for i, m in enumerate(crf.split_marginals([item[doc] for _, doc in kept[at:to]]), at):
            x[i, 1:] = m.max(initial=0.0), np.log1p(m.sum())
    head = np.zeros(3)
    for _ in range(30):  # Newton steps of a lightly penalised logistic fit
        p = 1 / (1 + np.exp(-x @ head))
        pull = np.diag([1e-3, 0.1, 0.1])
        head += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull + 1e-6 * np.eye(3), x.T @ (weight * (y - p)) - pull @ head)
    crf.head = head
    return crf


def _passages(texts: list[np.ndarray], size: int, width: int = 3) -> np.ndarray:
    """In how many different passages each word is: the lesser number of its different left and right sides of `width`
    words. A passage copied into many texts counts once for each of its words; ends of different texts are different."""
    mixed, words = ([], []), []
    for k, doc in enumerate(texts):
        ends = -(2 * width * k + np.arange(1, 2 * width + 1))
        laid = np.concatenate([ends[:width], doc, ends[width:]]).astype(np.int64).view(np.uint64)
        for side, shifts in zip(mixed, (range(width), range(width + 1, 2 * width + 1))):
            key = doc.astype(np.uint64)
            for at in shifts:
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + laid[at : at + len(doc)]
            side.append(key)
        words.append(doc)
    if not words:
        return np.zeros(size, np.int64)
    words, counts = np.concatenate(words), []
    for side in mixed:
        counts.append(np.bincount(words[np.unique(np.concatenate(side), return_index=True)[1]], minlength=size))
    return np.minimum(*counts)


def _train(windows: list[tuple[np.ndarray, np.ndarray, float]], size: int, steps: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray, float]:
    """Adagrad on the mean log likelihood of tagged windows (words, tags, weight); gradients are observed minus
    expected counts, added up over blocks of windows of one length."""
    e, tr, st = np.full(size, -3.0), np.zeros((2, 2)), -3.0
    ge, gt, gs = np.full(size, 1e-6), np.full((2, 2), 1e-6), 1e-6
    if not windows:
        return e, np.exp(tr), float(np.exp(st))
    by_length: dict[int, list] = {}
    for window in windows:
        by_length.setdefault(len(window[0]), []).append(window)
    parts = []  # windows of one length, place by place
    for _, same in sorted(by_length.items()):
        for at in range(0, len(same), block):
            x, t, w = zip(*same[at : at + block])
            parts.append((np.array(x).T.copy(), np.array(t, np.int64).T.copy(), np.array(w)))
    total = sum(w.sum() for _, _, w in parts)
    seen_t, seen_e, seen_s = np.zeros((2, 2)), np.zeros(size), 0.0
    for x, t, w in parts:
        wide = np.broadcast_to(w, x.shape)
        np.add.at(seen_t, (t[:-1].ravel(), t[1:].ravel()), wide[1:].ravel())
        seen_e += np.bincount(x.ravel(), (t * wide).ravel(), size)
        seen_s += (t[0] * w).sum()
    for _ in range(steps):
        a, up, begin = np.exp(tr), np.exp(e), np.exp(st)
        held_e, held_t, held_s = np.zeros(size), np.zeros((2, 2)), 0.0
        for x, _, w in parts:
            psi = up[x]
            r, ahead = np.empty(psi.shape), np.empty(psi.shape)  # odds of state 1 by what lies before, with the word; behind
            r[0], ahead[-1] = psi[0] * begin, 1.0
            for k in range(1, len(x)):
                r[k] = psi[k] * (a[0, 1] + a[1, 1] * r[k - 1]) / (a[0, 0] + a[1, 0] * r[k - 1])
            g = ahead.copy()  # ahead, with the word
            for k in range(len(x) - 1, 0, -1):
                g[k] = psi[k] * ahead[k]
                ahead[k - 1] = (a[1, 0] + a[1, 1] * g[k]) / (a[0, 0] + a[0, 1] * g[k])
            odds = r * ahead
            m = odds / (1 + odds) * w
            pairs = [[np.full(r[1:].shape, a[0, 0]), a[0, 1] * g[1:]], [a[1, 0] * r[:-1], a[1, 1] * r[:-1] * g[1:]]]
            share = w / (pairs[0][0] + pairs[0][1] + pairs[1][0] + pairs[1][1])
            held_e += np.bincount(x.ravel(), m.ravel(), size)
            held_t += [[(p * share).sum() for p in row] for row in pairs]
            held_s += m[0].sum()
        de = (seen_e - held_e) / total - 1e-4 * e
        dt = (seen_t - held_t) / total - 1e-4 * tr
        ds = (seen_s - held_s) / total - 1e-4 * st
        ge += de**2
        gt += dt**2
        gs += ds**2
        e, tr, st = e + 0.5 * de / np.sqrt(ge), tr + 0.5 * dt / np.sqrt(gt), st + 0.5 * ds / np.sqrt(gs)
    return e, np.exp(tr), float(np.exp(st))


def score(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), spans: bool = False) -> DataFrame:
    """docs' columns with toxicity (and toxic_spans, byte ranges), learned from the given labels (doc_id, toxic).

    Columns of docs that have one of these names are replaced.
    """
    docs = docs.drop("toxicity", "toxic_spans")
    spark = docs.sparkSession
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    few = training_sample(given, params.sample_rows)
    drawn = bounded_texts(texts.join(F.broadcast(few), "doc_id"), params.sample_text_bytes, params.sample_bytes)
    rows = drawn.orderBy("doc_id", F.xxhash64("text")).select("toxic", "text").collect()
    model = spark.sparkContext.broadcast(fit(((int(r[0] > 0), r[1].encode()) for r in rows), params))
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        from tabloom.llm._base import byte_texts

        crf = model.value
        for batch in batches:
            own = byte_texts(batch.column(place))
            p = np.full(len(own), crf) if isinstance(crf, float) else crf.scores(own)
            columns, names = [*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "toxicity"]
            if spans:
                found = [[] if isinstance(crf, float) or v < 0.5 else [{"start": a, "end": b} for a, b in crf.spans(x)] for x, v in zip(own, p)]
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("toxic_spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "toxicity double", *(["toxic_spans array<struct<start:bigint,end:bigint>>"] if spans else [])])
    return map_arrow(docs, run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """docs without the documents whose toxicity is one half or more."""
    renamed = plain(docs, "doc_id", "text")
    return score(renamed, labels, params).where(F.col("toxicity") < 0.5).select(*renamed.columns).toDF(*docs.columns)


def query(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    out = score(docs.select("doc_id", "text"), labels.where(fold(F.col("doc_id"), 5) != 0), params, spans=True)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
