"""Token-ID output: ids of a public tokenizer, stored per shard as a Re-Pair grammar.

A shard's ids are compressed by rounds of Re-Pair: the most frequent adjacent pairs become nonterminals, where of
overlapping pairs the more frequent (then the lesser) wins, and rounds go on until no pair occurs `least` times. The file
format is a Parquet folder with one row per shard: the remaining sequence, the rules (two symbols each), the
expansion length of every rule, and the ids and token counts of the shard's documents. Expansion lengths give the
place of any token, so `decode` opens any range without expanding what lies before it.

Edge cases: a null text is an empty one and has the end id only; null doc_ids come first; rows of equal doc_id stand
in the order of their text's hash, so only equal rows are interchangeable, and may lie in several parts; a text longer
than a shard is a shard of its own; a table without rows gives no shard. Other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import chunks, map_arrow, ragged, shared_path, split

FORMAT = "part int, shard int, local_start long, n_tokens long, first_rule int, sequence binary, rules binary, lengths binary, doc_ids binary, doc_null binary, doc_tokens binary"


@dataclass(frozen=True)
class TokenParams:
    """tokenizer: path of the vocabulary file (None: the installed public_tokenizers' word_bpe_49k.json);
    shard_tokens: tokens of a shard (one document at least); pairs, least: pairs that a Re-Pair round replaces at most,
    and occurrences that a pair needs; cache_words: words whose ids a worker holds between texts, of which the first
    third, where the frequent ones come up, outlives the others; text_bytes: texts that are encoded at once, one at least."""

    tokenizer: str | None = None
    end_id: int = 1
    shard_tokens: int = 1 << 20
    pairs: int = 8192
    least: int = 8
    cache_words: int = 600_000
    text_bytes: int = 1 << 23


#: ASCII characters that are neither letters, digits nor white space: a run of them behind letters is one piece.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Characters that stand for bytes in the vocabulary, by byte: the byte's own if it can be seen, else the next from 256
#: on. A space stays one, as it stands between words.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SEEN)))} | {32: " "}
#: Stems of letters that have one lower case each and no other composition.
LETTERS = "^[a-zß-öø-ÿÀ-ÖØ-Þ]+$"
#: Lower-casing these before they are composed, as they are not, composes them with a mark behind.
UNCOMPOSED = "[HJTWY][\u0308\u030A\u030C\u0331\u0344]|[HJTWY]\\p{M}\\p{M}"


class Encoder:
    """Ids of whole texts, word by word. The tokenizer splits at white space before anything else reaches across it,
    so the ids of a text are those of its words in turn; each distinct word is encoded once, and its ids are copied from
    one array for all its places. Lower-casing A-Z first makes fewer distinct words and no other ids, as the tokenizer
    lower-cases itself; texts where it would make others (a special token's name, letters that compose with a mark in
    lower case only) are encoded whole. Words and their ids are held in two Arrow arrays, a few bytes each."""

    _own: dict = {}

    def __init__(self, path: str, params: TokenParams):
        import pyarrow as pa
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.params = Tokenizer.from_file(path), params
        self.pieces = Tokenizer(self.tokenizer.model)  # words in, in characters that stand for bytes
        self.pieces.pre_tokenizer = WhitespaceSplit()
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([UNCOMPOSED, *(f"(?i:{t})" for t in special)])
        self.words = pa.array([], pa.binary())
        self.ids = pa.array([], pa.list_(pa.uint32()))  # by word

    @classmethod
    def of(cls, params: TokenParams) -> Encoder:
        path = params.tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        key = (path, params.cache_words, params.text_bytes)
        if key not in cls._own:
            cls._own[key] = cls(path, params)
        return cls._own[key]

    def _encode(self, texts: list[str], size: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each text) of texts that are encoded one by one."""
        ids, counts = [np.zeros(0, np.uint32)], []
        for at in range(0, len(texts), size):
            parts = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + size], add_special_tokens=False)]
            ids.append(np.array([i for x in parts for i in x], np.uint32))
            counts += [len(x) for x in parts]
        return np.concatenate(ids), np.array(counts, np.int64)

    def _letters(self, stems, size: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters that the normaliser leaves as they are, an Arrow array: each is one piece, whose
        last token alone is one that ends a word, so that one call serves many of them."""
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(stems), size):
            some = stems.slice(at, size)
            seen = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            if not seen.isascii():
                seen = seen.encode().decode("latin-1").translate(BYTES)
            own = np.array(self.pieces.encode_batch_fast([seen], add_special_tokens=False)[0].ids, np.uint32)
            n = np.diff(np.flatnonzero(self.ends_word[own]) + 1, prepend=0)
            if len(n) != len(some):
                own, n = self._encode(some.to_pylist())
            ids.append(own)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, words):
        """Lists of ids of distinct words, an Arrow array: of a stem of letters and of the marks behind it, or of the
        whole word where it is anything else."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = words.cast(pa.string())
        stems = pc.utf8_lower(head := pc.ascii_rtrim(text, characters=MARKS))
        letters = pc.match_substring_regex(head, LETTERS).to_numpy(zero_copy_only=False).copy()
        lengths = pc.binary_length(text).to_numpy().astype(np.int64)
        behind = lengths - pc.binary_length(head).to_numpy()
        own: dict[int, str] = {}
        for k, stem in zip(np.flatnonzero(~letters).tolist(), head.filter(pa.array(~letters)).to_pylist()):
            if stem.isalpha() and "Σ" not in stem and "İ" not in stem:
                stem = stem.lower()  # of single characters, as the tokenizer does it
                if stem.isalpha() and stem == stem.lower() and unicodedata.is_normalized("NFC", stem):
                    own[k] = stem
        at = np.fromiter(own, np.int64, len(own))
        whole = ~letters
        whole[at] = False
        behind[whole] = 0
        # tables of stems, of marks (the first: none) and of whole words, one behind the other; a word is in two places
        simple = pa.concat_arrays([stems.filter(pa.array(letters)), pa.array(own.values(), pa.string())]).dictionary_encode()
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset + 1 : text.offset + 1 + len(text)].astype(np.int64)
        size = np.concatenate([[0], np.cumsum(behind)]).astype(np.int32)
        marks = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(size), pa.py_buffer(data[ragged(ends - behind, behind)])]).dictionary_encode()
        n, m = len(simple.dictionary), len(marks.dictionary)
        made = [self._letters(simple.dictionary), self._encode(marks.dictionary.to_pylist()), self._encode(text.filter(pa.array(whole)).to_pylist())]
        table = _lists(*(np.concatenate(x) for x in zip(*made)))
        first = np.empty(len(text), np.int64)
        first[np.concatenate([np.flatnonzero(letters), at])] = simple.indices.to_numpy()
        first[whole] = n + m + np.arange(int(whole.sum()))
        both = np.stack([first, n + marks.indices.to_numpy()], 1).ravel()
        ids, counts = _flat(table.take(pa.array(both)))
        return _lists(ids, counts.reshape(-1, 2).sum(1))

    def _words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word) of words laid end to end, an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > self.params.cache_words:  # the first third stays
            kept = pa.array(np.arange(self.params.cache_words // 3))
            self.words, self.ids = self.words.take(kept), self.ids.take(kept)
        number = pc.index_in(words, value_set=self.words)
        if number.null_count:
            new = words.filter(number.is_null()).dictionary_encode()
            held = len(self.words)
            self.ids = pa.concat_arrays([self.ids, self._learn(new.dictionary)])
            self.words = pa.concat_arrays([self.words, new.dictionary])
            number = pc.replace_with_mask(number, number.is_null(), pc.add(new.indices, pa.scalar(held, pa.int32())))
        return _flat(self.ids.take(number))

    def encode(self, column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids laid end to end, number of ids of each text) of some texts at a time, of an Arrow string column."""
        import pyarrow as pa
        import pyarrow.compute as pc

        for texts in chunks(column, self.params.text_bytes):
            whole = pc.match_substring_regex(texts, self.whole).fill_null(False)
            odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            lengths, words = split(pc.if_else(whole, pa.scalar(None, texts.type), texts) if len(odd) else texts)
            ids, counts = self._words(words)
            upto, ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]), np.cumsum(lengths)
            counts = upto[ends] - upto[ends - lengths]
            if len(odd):
                own, n = self._encode(texts.take(pa.array(odd)).to_pylist(), 1)
                ids = np.insert(ids, np.repeat(np.cumsum(counts)[odd], n), own)
                counts[odd] = n
            yield ids, counts


def _lists(flat: np.ndarray, counts: np.ndarray):
    """An Arrow array of lists that are laid end to end."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.uint32()))


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """(values laid end to end, number of each list) of an Arrow array of lists."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64)


def compress(ids: np.ndarray, first_rule: int, params: TokenParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules (n, 2), expansion lengths): symbols from first_rule on are rules.

    Only places whose pair can be frequent are looked at: those whose pair was in the round before, by an upper bound
    from counts of hashed pairs, and those beside a new symbol; other pairs only become rarer.
    """
    a = ids.astype(np.int64)
    rules, lengths, top = [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64), first_rule
    bits, live = 20, np.arange(max(0, len(a) - 1))
    while len(live):
        key = (a[live] << 32) | a[live + 1]
        slot = _slot(key, bits)
        can = np.bincount(slot, minlength=1 << bits)[slot] >= params.least
        live, key, slot = live[can], key[can], slot[can]
        ordered = np.sort(key)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
        number = np.diff(begin, append=len(ordered))
        often = np.flatnonzero(number >= params.least) if len(ordered) else np.zeros(0, np.int64)
        if not len(often):
            break
        best = often[np.argsort(-number[often], kind="stable")[: params.pairs]]
        pairs = ordered[begin[best]]
        # pairs by a hashed slot; of those that share one the most frequent stays for this round
        held = _slot(pairs, bits)
        holder = np.full(1 << bits, -1, np.int32)
        holder[held[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        rank = holder[slot]
        some = np.flatnonzero((rank >= 0) & (pairs[rank] == key))
        place, rank = live[some], rank[some]
        beside = np.diff(place) == 1
        equal = np.concatenate([[False], beside & (rank[1:] == rank[:-1])])
        run = np.arange(len(rank)) - np.maximum.accumulate(np.where(equal, 0, np.arange(len(rank))))
        over = np.concatenate([beside & (rank[1:] < rank[:-1]), [False]])  # the next pair goes first
        under = np.concatenate([[False], beside & (rank[:-1] < rank[1:])])  # the one before does
        chosen = (run % 2 == 0) & ~over & ~under
        at, drawn = place[chosen], rank[chosen]
        use = np.zeros(len(pairs), bool)
        use[drawn] = True
        used = np.flatnonzero(use)
        a[at] = top + np.cumsum(use)[drawn] - 1
        keep = np.ones(len(a), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        a = a[keep]
        near = moved[at]
        mark = np.zeros(len(a) + 1, bool)
        mark[moved[live[keep[live]]]] = True
        mark[near] = True
        mark[near[near > 0] - 1] = True
        live = np.flatnonzero(mark[: max(0, len(a) - 1)])
        body = np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1)
        lengths = np.concatenate([lengths, _measure(body, lengths, first_rule).sum(1)])
        rules.append(body)
        top += len(used)
    return a.astype(np.uint32), np.concatenate(rules).astype(np.uint32), lengths.astype(np.uint32)


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _measure(symbols: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    out = np.ones(symbols.shape, np.int64)
    inner = symbols >= first_rule
    out[inner] = lengths[symbols[inner].astype(np.int64) - first_rule]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that the symbols stand for: every rule once, then all symbols by copying."""
    table = np.arange(first_rule, dtype=np.uint32)
    flat = np.zeros(int(lengths.sum(dtype=np.int64)), np.uint32)
    begin = np.cumsum(lengths, dtype=np.int64) - lengths

    def copy(s: np.ndarray) -> np.ndarray:
        s = s.astype(np.int64)
        n = _measure(s, lengths, first_rule)
        out = np.empty(int(n.sum()), np.uint32)
        ends = np.cumsum(n)
        inner = s >= first_rule
        out[(ends - n)[~inner]] = table[s[~inner]]
        where = ragged((ends - n)[inner], n[inner])
        out[where] = flat[ragged(begin[s[inner] - first_rule], n[inner])]
        return out

    done = 0
    while done < len(rules):  # rules whose bodies are known by now
        deep = np.maximum(rules[done:, 0], rules[done:, 1]).astype(np.int64)
        known = int(np.argmax(deep >= first_rule + done)) if (deep >= first_rule + done).any() else len(deep)
        part = slice(done, done + known)
        flat[ragged(begin[part], lengths[part].astype(np.int64))] = copy(rules[part].ravel())
        done += known
    return copy(symbols)


class Shard:
    """A row of the file format."""

    def __init__(self, row: dict):
        self.first_rule = row["first_rule"]
        self.sequence, self.rules, self.lengths = (np.frombuffer(row[k], np.uint32) for k in ("sequence", "rules", "lengths"))
        self.rules = self.rules.reshape(-1, 2)
        self.doc_ids, self.doc_tokens = (np.frombuffer(row[k], np.int64) for k in ("doc_ids", "doc_tokens"))
        self.doc_null = np.frombuffer(row["doc_null"], bool)
        self._ends = None

    def ids(self) -> np.ndarray:
        return expand(self.sequence, self.rules, self.lengths, self.first_rule)

    def decode(self, start: int, count: int) -> np.ndarray:
        """Ids start to start + count of the shard, expanding only symbols that overlap them."""
        if self._ends is None:
            self._ends = np.cumsum(_measure(self.sequence, self.lengths, self.first_rule))
        a, b = np.searchsorted(self._ends, start, "right"), np.searchsorted(self._ends, start + count, "left") + 1
        skip = start - (int(self._ends[a - 1]) if a else 0)
        return expand(self.sequence[a:b], self.rules, self.lengths, self.first_rule)[skip : skip + count]

    def document(self, k: int) -> np.ndarray:
        return self.decode(int(self.doc_tokens[:k].sum()), int(self.doc_tokens[k]))


def write(docs: DataFrame, path: str, params: TokenParams = TokenParams()) -> None:
    """Write the shards of docs (doc_id, text), in ascending doc_id order over parts and shards."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = Encoder.of(params), TaskContext.get().partitionId()
        first_rule = encoder.tokenizer.get_vocab_size()
        names = [f.split()[0] for f in FORMAT.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
        shard, start, size = 0, 0, 0
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # doc_ids, whether null, ids, their numbers

        def flush():
            nonlocal shard, start, own, size
            doc_ids, nulls, flat, counts = (np.concatenate(x) for x in zip(*own))
            sequence, rules, lengths = compress(flat, first_rule, params)
            row = [part, shard, start, len(flat), first_rule, *(x.tobytes() for x in (sequence, rules, lengths, doc_ids, nulls, counts))]
            shard, start, own, size = shard + 1, start + len(flat), [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            at, nulls = 0, batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            for ids, counts in encoder.encode(batch.column(1)):
                flat, counts = np.insert(ids, np.cumsum(counts), np.uint32(params.end_id)), counts + 1
                ends, k = np.cumsum(counts), 0
                while k < len(counts):
                    before = int(ends[k - 1]) if k else 0
                    # texts that the shard still has room for; at least one if it is empty
                    to = max(int(np.searchsorted(ends, before + params.shard_tokens - size, "right")), k + (not own))
                    if to > k:
                        own.append((doc_ids[at + k : at + to], nulls[at + k : at + to], flat[before : ends[to - 1]], counts[k:to]))
                        size += int(ends[to - 1]) - before
                    if to < len(counts):
                        yield flush()
                    k = to
                at += len(counts)
        if own:
            yield flush()

    map_arrow(dealt, run, FORMAT).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    shards = spark.read.schema(FORMAT).parquet(path)
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row for each task that wrote
    starts, total = {}, 0
    for part, n in sorted(tuple(r) for r in per_part):
        starts[part] = total
        total += n
    given = spark.sparkContext.broadcast(starts)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                flat = shard.ids()
                ends = np.cumsum(shard.doc_tokens)
                begin = ends - shard.doc_tokens
                crc = [zlib.crc32(flat[a:b].data) for a, b in zip(begin.tolist(), ends.tolist())]
                start = given.value[row["part"]] + row["local_start"]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.doc_null), pa.array(begin + start), pa.array(shard.doc_tokens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(shards, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(docs: DataFrame, params: TokenParams = TokenParams()) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write(docs, path, params)
    return read(spark, path)
