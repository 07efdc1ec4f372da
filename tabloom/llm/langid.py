"""Language identification: multinomial naive Bayes over hashed character n-grams.

Edge cases: a null or empty text or one without a letter (digits and number signs such as one half are none) gets
`und` with score 0, as does every text where nothing could be learned (no labelled rows). Very long texts are scored
whole, in overlapping pieces. Repeated rows are scored alike; ties between languages go to the first in code-point
order; a table without rows gives none. Columns of the input other than doc_id and text, whatever their names, are
not looked at when predicting and are not returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import blocks, bounded_texts, fold, training_sample

_WORD = re.compile(r"[^\W\d_]+")  # letters, and number signs that are no digits
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass(frozen=True)
class LangIdParams:
    """bits: log2 of the hashed feature space; sample_rows, sample_bytes: bound of the training sample, in rows and in
    bytes of their texts; sample_text_bytes: a longer text is represented by passages of it; max_cells: bound on
    languages x buckets of the broadcast matrix (float32)."""

    bits: int = 15
    orders: int = 3
    alpha: float = 0.3
    sample_rows: int = 6000
    sample_bytes: int = 48_000_000
    sample_text_bytes: int = 200_000
    max_cells: int = 1 << 26
    block_chars: int = 1 << 20


def _grams(codes: np.ndarray, ends: np.ndarray, bits: int, orders: int):
    """Bucket of the n-gram that starts at each position, order by order; 2**bits where it leaves its text."""
    shift, none = np.uint32(32 - bits), 1 << bits
    lengths = np.diff(ends, prepend=0)
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    h = np.full(len(codes), 17, np.uint32)
    for n in range(orders):
        h[: len(h) - n] = (h[: len(h) - n] ^ codes[n:]) * _MIX[n % 3] + np.uint32(n)
        h ^= h >> np.uint32(15)
        bucket = ((h * _MIX[0]) >> shift).astype(np.int32)
        bucket[left <= n] = none
        yield bucket


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([len(t) for t in texts])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in _WORD.finditer(text) for c in m[0])


class NaiveBayes:
    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray, params: LangIdParams):
        self.languages, self.weights, self.prior, self.params = languages, weights, prior, params

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], params: LangIdParams) -> NaiveBayes | None:
        """rows: (language, text)."""
        languages = sorted({lang for lang, _ in rows})
        if not languages:
            return None
        if len(languages) << params.bits > params.max_cells:
            raise ValueError(f"{len(languages)} languages exceed the bound of the broadcast matrix; lower bits or raise max_cells")
        index = {lang: i for i, lang in enumerate(languages)}
        counts = np.zeros((len(languages), (1 << params.bits) + 1))
        n = np.zeros(len(languages))
        for lang in languages:
            own = [t.lower() for code, t in rows if code == lang]
            n[index[lang]] = len(own)
            for a, b in blocks(own, params.block_chars):
                codes, ends = _codes(own[a:b])
                for bucket in _grams(codes, ends, params.bits, params.orders):
                    counts[index[lang]] += np.bincount(bucket, minlength=counts.shape[1])
        counts = counts[:, :-1] + params.alpha
        logp = np.log(counts / counts.sum(1, keepdims=True))
        logp -= logp.mean(0)  # the same for all languages: it leaves posteriors as they are and keeps sums small
        weights = np.zeros(((1 << params.bits) + 1, len(languages)), np.float32)
        weights[:-1] = logp.T
        return cls(languages, weights, np.log(n / n.sum()), params)

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """Unnormalised log posterior of each language for each (whole) text."""
        out = np.tile(self.prior, (len(texts), 1))
        size, over = self.params.block_chars, self.params.orders - 1
        pieces, owner, own_end = [], [], []
        for i, text in enumerate(texts):
            low = text.lower()
            for at in range(0, max(len(low), 1), size):
                pieces.append(low[at : at + size + over])
                owner.append(i)
                own_end.append(min(size, len(low) - at))
        for a, b in blocks(pieces, size):
            codes, ends = _codes(pieces[a:b])
            if not len(codes):
                continue
            lengths = np.diff(ends, prepend=0)
            starts = ends - lengths
            full = lengths > 0
            keep = None
            if any(own_end[k] < len(pieces[k]) for k in range(a, b)):  # what overlaps into the next piece counts there
                keep = np.arange(len(codes)) - np.repeat(starts, lengths) < np.repeat(own_end[a:b], lengths)
            for bucket in _grams(codes, ends, self.params.bits, self.params.orders):
                if keep is not None:
                    bucket = np.where(keep, bucket, len(self.weights) - 1)
                sums = np.add.reduceat(self.weights[bucket], starts[full], axis=0)
                np.add.at(out, np.asarray(owner[a:b])[full], sums)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        given = [t or "" for t in texts]
        z = self.log_odds(given)
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        best = z.argmax(1)
        letter = [has_letter(t) for t in given]
        return [self.languages[k] if ok else "und" for k, ok in zip(best, letter)], np.where(letter, z.max(1), 0.0)


def identify(docs: DataFrame, training: DataFrame, params: LangIdParams = LangIdParams()) -> DataFrame:
    """docs' doc_id and text with lang_pred and score, learned from training's lang and text."""
    spark = docs.sparkSession
    drawn = training_sample(training.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL"), params.sample_rows)
    rows = bounded_texts(drawn, params.sample_text_bytes, params.sample_bytes).select("lang", "text").collect()
    model = spark.sparkContext.broadcast(NaiveBayes.fit([(r[0], r[1]) for r in rows], params))

    def score(batches):
        import pyarrow as pa

        nb = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, p = nb.predict(texts) if nb else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame, params: LangIdParams = LangIdParams()) -> DataFrame:
    out = identify(docs, docs.where(fold(F.col("doc_id"), 4) != 2), params)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
