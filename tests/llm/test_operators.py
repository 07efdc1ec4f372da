"""Each corpus operator against a plain version of itself, held-out labels or a round trip, and at the edges."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import _graph, decontaminate, langid, linededup, lmscore, merkle, mixing, pii, simhash, tokenids, toxicity
from tabloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_ string, copies_ string, toxicity double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def edge(spark):
    long = " ".join(f"word{i % 97} the" for i in range(30000))
    data = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "The cat sat, on the mat.\nAgain", "en", "a"),
        (4, "The cat sat, on the mat.\nAgain", "en", "a"), (5, long, "en", None), (6, long + " x", "de", "b"), (None, "nobody here", "en", "b"),
        (None, None, None, None), (7, "12345 67890", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, None, "x", "y", None) for r in data], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [r.asDict() for r in df.collect()]


def crc_fold(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def test_language_held_out(docs, rows):
    out = {r["doc_id"]: r for r in got(langid.query(docs))}
    lang = {i: la for i, _, la, _ in rows}
    held = [r for r in out.values() if r["held_out"]]
    assert len(out) == len(rows) and all(r["held_out"] == (crc_fold(i, 4) == 2) for i, r in out.items())
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_edges(edge, empty):
    out = got(langid.query(edge))
    assert len(out) == 10
    assert [r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 7)] == ["und"] * 4
    assert langid.query(empty).count() == 0
    model = langid.NaiveBayes.fit([("a", "abc abd"), ("b", "xyz xyw")], langid.LangIdParams(block_chars=5))
    whole = langid.NaiveBayes(model.languages, model.weights, model.prior, langid.LangIdParams())
    text = "abcxyzabd" * 7
    assert np.allclose(model.log_odds([text, "", "q"]), whole.log_odds([text, "", "q"]), atol=1e-4)


def luhn_ok(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[::2]) % 10 == 0 if len(d) < 2 else (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pii_formats(spark):
    text = (
        "mail ann.lee7@mail.example.com card 4111 1111 1111 1111 and 4111-1111-1111-1112 ip 10.0.0.255 bad 300.1.1.1 "
        "ssn 123-45-6789 bad 000-12-3456 born 1987-02-28 or 28/02/1987, 31.12.1999; 2001-13-40 tel +1 (555) 123-4567 "
        "iban GB82 WEST 1234 5698 7654 32 bad GB83 WEST 1234 5698 7654 32."
    )
    frame = spark.createDataFrame([(1, text), (2, "again 4111111111111111 ann.lee7@mail.example.com"), (3, None), (4, ""), (5, "plain words")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in got(pii.pseudonyms(frame, "k"))}
    new = out[1]["text"]
    kinds = [p["kind"] for p in out[1]["pii"]]
    assert Counter(kinds) == Counter(["mail", "card", "ip", "ssn", "date", "date", "date", "phone", "iban"])
    for old in ("ann.lee7@", "4111 1111 1111 1111", "10.0.0.255", "123-45-6789", "1987-02-28", "28/02/1987", "31.12.1999", "123-4567", "GB82 WEST"):
        assert old not in new
    for kept in ("4111-1111-1111-1112", "300.1.1.1", "000-12-3456", "2001-13-40", "GB83 WEST 1234 5698 7654 32"):
        assert kept in new
    assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text))) or "ip" in kinds
    by = {p["kind"]: p["pseudonym"] for p in out[1]["pii"]}
    assert luhn_ok(by["card"]) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", by["card"])
    again = {p["kind"]: p["pseudonym"] for p in out[2]["pii"]}
    assert again["mail"] == by["mail"] and again["card"] == by["card"].replace(" ", "")
    iban = re.sub(" ", "", by["iban"])
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == "plain words"


def test_pii_permutes(spark):
    moved = [r[0] for r in spark.range(189 * 8).select(pii.permute_number(F.col("id"), 189, 8, "k", F.lit("t"))).collect()]
    assert sorted(moved) == list(range(189 * 8)) and moved != sorted(moved)
    moved = [r[0] for r in spark.range(1000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", F.lit("t"))).collect()]
    assert sorted(moved) == [f"{i:03d}" for i in range(1000)]


def test_pii_whole_table(docs, rows):
    out = {r["doc_id"]: r for r in got(pii.query(docs))}
    assert len(out) == len(rows)
    mail = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+[\w]")
    assert any(r["n_replaced"] for r in out.values())
    for i, text, _, _ in rows:
        assert len(out[i]["text"]) == len(text) or "ip" in out[i]["kinds"]
        assert not set(mail.findall(text)) & set(mail.findall(out[i]["text"]))
        if not re.search(r"[0-9@]", text):
            assert out[i]["text"] == text


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def token_rows(rows, tokenizer):
    out, start = Counter(), 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out[(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    return out


def test_token_ids_round_trip(docs, rows, tokenizer):
    out = got(tokenids.query(docs))
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out) == token_rows([(i, t) for i, t, _, _ in rows], tokenizer)


def test_token_ids_edges(edge, empty, tokenizer):
    out = got(tokenids.query(edge, tokenids.TokenParams(shard_tokens=500)))
    want = token_rows([(r.doc_id, r.text) for r in edge.collect()], tokenizer)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((a, c, d) for a, _, c, d in want.elements())
    assert tokenids.query(empty).count() == 0
    odd = "CAFÉ Ünïcode  don't... a.b, c,d. 3.14 x. y\tz w İstanbul ΣΑΣ 'll"
    texts = [odd, odd.lower(), "", "  ", "…", "a\n\n.b .", None, "x" * 3000, "café. naïve, straße. ÉCOLE e\u0301t\u00e9 ŉ ǆ ﬁn.", ". , .. ,, a.. b,,", "a\u00a0b\x1cc\x85d\u2028e\x0bf\rg"] * 3
    for params in (tokenids.TokenParams(), tokenids.TokenParams(cache_words=12, text_bytes=60)):
        encoder = tokenids.Encoder.of(params)
        parts = [p for ids, counts in encoder.encode(pa.array(texts, pa.string())) for p in np.split(ids, np.cumsum(counts)[:-1])]
        assert [p.tolist() for p in parts] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_ids_ties(spark, tokenizer):
    """Rows of one doc_id stand in the order of their text's hash, whatever the order of the input."""
    frame = spark.createDataFrame([(i, t) for i in (None, 3, 3, -5) for t in ("one two", "three", None, "", "one two", "x " * 50)], "doc_id long, text string")
    params = tokenids.TokenParams(shard_tokens=40)
    out = sorted(tuple(r) for r in tokenids.query(frame, params).select("start", F.coalesce("doc_id", F.lit(-99)), "n_tokens", "ids_crc32").collect())
    again = sorted(tuple(r) for r in tokenids.query(frame.orderBy(F.desc("text")).repartition(5), params).select("start", F.coalesce("doc_id", F.lit(-99)), "n_tokens", "ids_crc32").collect())
    assert out == again and [r[1] for r in out] == sorted(r[1] for r in out)
    assert [r[0] for r in out] == np.cumsum([0, *(r[2] for r in out[:-1])]).tolist()


def test_token_ids_of_texts_that_lower_case_otherwise(tokenizer):
    """Special tokens are named in lower case only, and some letters compose with a mark in lower case only."""
    texts = ["<|ENDOFTEXT|> a", "a<|EndOfText|>b C", "<|endoftext|>.", "J\u030c x", "H\u0331x", "T\u0308", "A W\u030a", "Y\u030a", "H\u0323\u0331", "J\u030b", "plain Text"]
    for params in (tokenids.TokenParams(), tokenids.TokenParams(text_bytes=1)):
        parts = [p for ids, counts in tokenids.Encoder.of(params).encode(pa.array([*texts, None, *texts])) for p in np.split(ids, np.cumsum(counts)[:-1])]
        assert [p.tolist() for p in parts] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in [*texts, None, *texts]]


def test_token_ids_hold_words_in_few_bytes():
    """Of a word that a worker holds: its own bytes and ids, and little else."""
    import gc
    import tracemalloc

    import public_tokenizers

    letters = [chr(97 + k) for k in range(26)]
    words = ["".join(letters[k // 26**i % 26] for i in range(4)) for k in range(50_000)]
    encoder = tokenids.Encoder(public_tokenizers.path("word_bpe_49k.json"), tokenids.TokenParams())
    column = pa.array([" ".join(words)])
    gc.collect()
    tracemalloc.start()
    try:
        before = pa.total_allocated_bytes()
        for _ in encoder.encode(column):
            pass
        del _
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 60 * len(words)


def test_token_ids_of_marks_behind_letters(tokenizer, monkeypatch):
    """Words of letters and marks are taken apart, so that the tokenizer does not get them one by one."""
    import public_tokenizers

    single, encode = [], tokenids.Encoder._encode
    monkeypatch.setattr(tokenids.Encoder, "_encode", lambda self, texts, *rest: single.extend(texts) or encode(self, texts, *rest))
    stems = [a + b + c for a in ("the", "Él", "straß", "naïv", "onre") for b in ("ing", "ção", "heit", "a") for c in "bcdefgh"]
    texts = [" ".join(stem + mark for stem in stems) for mark in ("", ".", "###", ",%%%", "'", "...", "\"),", "|>")]
    encoder = tokenids.Encoder(public_tokenizers.path("word_bpe_49k.json"), tokenids.TokenParams())
    parts = [p for ids, counts in encoder.encode(pa.array(texts)) for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert [p.tolist() for p in parts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(single) < len(stems)


def test_repair_and_random_access():
    rng = np.random.default_rng(3)
    params = tokenids.TokenParams(least=2)
    for ids in (rng.zipf(1.3, 20000) % 500, np.zeros(999, int), np.array([5, 6] * 301 + [5]), np.array([7]), np.arange(50)):
        ids = ids.astype(np.uint32)
        sequence, rules, lengths = tokenids.compress(ids, 1000, params)
        assert (tokenids.expand(sequence, rules, lengths, 1000) == ids).all()
        row = {"first_rule": 1000, "sequence": sequence.tobytes(), "rules": rules.tobytes(), "lengths": lengths.tobytes(), "doc_ids": b"", "doc_tokens": b"", "doc_null": b""}
        shard = tokenids.Shard(row)
        for _ in range(20):
            a = int(rng.integers(0, len(ids)))
            n = int(rng.integers(1, 40))
            assert (shard.decode(a, n) == ids[a : a + n]).all()
        # no pair is left that occurs often
        pairs = Counter(zip(sequence[:-1].tolist(), sequence[1:].tolist()))
        assert all(n < 2 * params.least for n in pairs.values())
    assert len(tokenids.compress(np.array([5, 6] * 3000, np.uint32), 1000, params)[0]) < 16


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def leaks(rows, items, width=10):
    grams = defaultdict(set)
    for item, text in items:
        w = WORD.findall(ascii_lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            grams[tuple(w[i : i + width])].add(item)
    out = []
    for doc, text in rows:
        w = WORD.findall(ascii_lower(text))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def flat(df):
    return Counter(tuple(r) for r in df.collect())


def test_decontamination(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = leaks([(i, t) for i, t, _, _ in rows], items)
    assert flat(decontaminate.query(docs, bench)) == want and any(k[5] for k in want)
    small = decontaminate.DecontaminationParams(shard_words=300, sample=3, block_words=200)
    assert flat(decontaminate.query(docs, bench, small)) == want


def test_decontamination_edges(spark, edge, empty):
    items = [(1, "the cat sat on"), (2, "the CAT sat on"), (3, None), (4, ""), (5, "word1 the"), (10, "mat again"), (6, " ".join(f"word{i} the" for i in range(9)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert flat(decontaminate.query(edge, bench)) == leaks([(r.doc_id, r.text) for r in edge.collect()], items)
    assert flat(decontaminate.query(edge, bench.limit(0))) == leaks([(r.doc_id, r.text) for r in edge.collect()], [])
    assert decontaminate.query(empty, bench).count() == 0
    kept = decontaminate.clean(edge, bench)
    assert kept.columns == edge.columns and kept.count() == 6


def test_fm_index():
    rng = np.random.default_rng(1)
    for size, symbols in ((400, 4), (3000, 50), (60, 2)):
        text = rng.integers(0, symbols, size)
        text[: size // 2] = text[size // 2 : size // 2 * 2]
        text[-1] = 0
        index = decontaminate.FMIndex(text, symbols, 5)
        for n in (1, 2, 3, 5):
            for _ in range(30):
                p = rng.integers(1, symbols, n)
                low, high = index.search(np.concatenate([np.zeros(5 - n, int), p])[None], np.array([n]))
                want = [i for i in range(size - n + 1) if (text[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(low[0], high[0])).tolist() if low[0] < high[0] else []) == want


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", ascii_lower(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_simhash(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in prints})
    root = plain_components(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 4])
    least = defaultdict(lambda: math.inf)
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(least[root[f]], i)
    return Counter((i, f"{f:016x}", None if least[root[f]] == math.inf else least[root[f]]) for i, f in prints)


def test_simhash_components(docs, rows):
    want = plain_simhash([(i, t) for i, t, _, _ in rows])
    assert flat(simhash.query(docs)) == want
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


def test_simhash_edges(edge, empty):
    assert flat(simhash.query(edge)) == plain_simhash([(r.doc_id, r.text) for r in edge.collect()])
    assert simhash.query(empty).count() == 0
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 7]


def test_simhash_keeps_unlike_texts(spark):
    """Null ids and repeated ids of unlike texts are rows of their own; of equal rows one stays."""
    words = [[f"{a}{i}" for i in range(40)] for a in "abcdefg"]
    texts = [" ".join(w) for w in words]
    rows = [(None, texts[0], "x"), (None, texts[1], "x"), (None, texts[2], "x"), (8, texts[3], "x"), (9, texts[4], "x"), (9, texts[5], "y"), (9, texts[5], "x")]
    rows += [(None, texts[3], "z"), (4, texts[6], "x"), (5, texts[6], "x"), (4, texts[6], "x"), (7, None, "x"), (6, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, a_ string")
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    out = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert out == sorted([(None, texts[0]), (None, texts[1]), (None, texts[2]), (8, texts[3]), (9, texts[4]), (9, texts[5]), (4, texts[6]), (6, "")], key=str)
    assert out == sorted(((r.doc_id, r.text) for r in simhash.keep_first(frame.repartition(3)).collect()), key=str)
    assert simhash.keep_first(frame.limit(0)).count() == 0


def test_golay_keys_find_all_links():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.int64) * rng.choice([-1, 1], 4000)
    b = a.copy()
    for k in range(4000):
        for bit in rng.choice(64, k % 5, replace=False):
            b[k] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    ka, ra, oa = simhash.keys(a)
    kb, rb, _ = simhash.keys(b)
    own, look = defaultdict(set), defaultdict(set)
    for k, r, o in zip(ka.tolist(), ra.tolist(), oa.tolist()):
        if o:
            own[r].add(k)
    for k, r in zip(kb.tolist(), rb.tolist()):
        look[r].add(k)
    assert all(own[r] & look[r] for r in range(4000))
    assert len(ka) < 330 * len(a)
    # unrelated fingerprints hardly ever share a key
    chance = Counter(ka[oa].tolist())
    assert sum(n - 1 for n in chance.values()) < 20


def test_golay_keys_in_all_ways_of_four_bits():
    """Each way to lay 4 bits over the segments, some thousand times."""
    rng = np.random.default_rng(7)
    for way in [w for w in itertools.product(range(5), repeat=3) if sum(w) <= 4]:
        a = rng.integers(0, 1 << 63, 300, dtype=np.int64)
        b = a.copy()
        for k in range(300):
            for (at, n), e in zip(simhash.SEGMENTS, way):
                for bit in rng.choice(n, e, replace=False):
                    b[k] ^= np.uint64(1 << (at + int(bit))).view(np.int64)
        ka, ra, oa = simhash.keys(a)
        kb, rb, ob = simhash.keys(b)
        first = set(zip(ra[oa].tolist(), ka[oa].tolist())) & set(zip(rb.tolist(), kb.tolist()))
        assert {r for r, _ in first} == set(range(300)), way


def test_simhash_forest_of_dense_groups():
    rng = np.random.default_rng(4)
    fp = np.unique(np.array([sum(1 << int(x) for x in rng.choice(40, rng.integers(0, 4), replace=False)) for _ in range(3500)], np.int64))
    pairs = [(int(x), int(y)) for u, v in simhash.forest(fp) for x, y in zip(u, v)]
    assert all((x ^ y).bit_count() <= 4 for x, y in pairs)
    assert len(set(plain_components(fp.tolist(), pairs).values())) == 1


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (7, 7), (200, 201)]
    out = {r.node: r.root for r in _graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 105: 100, 200: 200, 201: 200}
    assert _graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity_held_out(spark, docs):
    sf = "/root/testdata/sf0.1"
    big, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r for r in got(toxicity.query(big, labels)) if r["held_out"] and r["doc_id"] in truth]
    y, p = np.array([truth[r["doc_id"]] for r in out]), np.array([r["score"] for r in out])
    order = p.argsort(kind="stable").argsort()
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    flagged = np.array([r["predicted"] for r in out])
    assert auc > 0.93 and flagged[y == 0].mean() < 0.01 and flagged[y == 1].mean() > 0.9
    lang = {r.doc_id: r.lang for r in big.select("doc_id", "lang").collect()}
    for own in ("de", "en", "es", "fr"):
        here = np.array([lang[r["doc_id"]] == own for r in out])
        assert flagged[here & (y == 1)].mean() > 0.6 and flagged[here & (y == 0)].mean() < 0.03, own
    assert all(r["toxic_spans"] for r in out if r["predicted"])


def test_toxicity_rare_words_and_copied_passages():
    """A toxic word in far fewer texts than the most frequent one is learned; the words of a copied passage are not."""
    rng = np.random.default_rng(4)

    def text(*more):
        words = [f"w{i}" for i in rng.integers(0, 300, 60)]
        for m in more:
            at = int(rng.integers(15, 45))
            words[at:at] = m.split()
        return " ".join(words).encode()

    rows = [(0, text()) for _ in range(600)] + [(1, text("vile")) for _ in range(150)] + [(1, text("rarevile")) for _ in range(20)]
    rows += [(1, text("vile", "copied passage that ran along unchanged into many texts")) for _ in range(30)]
    crf = toxicity.fit(rows, toxicity.ToxicityParams())
    scores = crf.scores([text("rarevile") for _ in range(20)])
    assert (scores > 0.5).all() and (crf.scores([text() for _ in range(20)]) < 0.5).all()
    assert (crf.scores([text("copied passage that ran along unchanged into many texts") for _ in range(20)]) < 0.5).all()


def test_crf_marginals():
    a, start, params = np.array([[1.0, 0.2], [0.5, 2.0]]), 0.3, toxicity.ToxicityParams()
    emission = np.array([-1.0, 2.0, 0.5])
    crf = toxicity.ToxicCRF({}, emission, a, start, np.zeros(3), params)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 3, n) for n in (1, 5, 2, 7, 3)]
    want = []
    for ids in texts:
        z = np.zeros(len(ids) + 1)
        for path in itertools.product((0, 1), repeat=len(ids)):
            w = start if path[0] else 1.0
            for x, y in zip(path, path[1:]):
                w *= a[x, y]
            w *= math.exp(sum(emission[i] for i, s in zip(ids, path) if s))
            z += w * np.array([*path, 1])
        want.append(z[:-1] / z[-1])
    ids = np.concatenate(texts)
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *map(len, texts[:-1])])] = True
    assert np.allclose(crf.marginals(ids, first), np.concatenate(want))


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, 0), (7, 0), (3, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in got(toxicity.query(edge, labels)))
    assert toxicity.query(edge, labels.limit(0)).count() == 10 and toxicity.query(empty, labels).count() == 0
    kept = toxicity.without_toxic(edge, labels)
    assert kept.columns == edge.columns and {r.copies_ for r in kept.collect()} == {"y"}


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(held.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not over:
            return {s: held.get(s, level * w[s]) for s in names}
        held |= {s: 3 * sizes[s] for s in over}


def plain_copies(sizes, rate):
    """Floor or ceiling of the rate for each document, from the largest on, whichever leaves less owed."""
    low, owed, out = math.floor(rate), 0.0, {}
    for i, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        owed += size * rate
        out[i] = min((low, low + (rate > low)), key=lambda k: (abs(owed - k * size), k))
        owed -= out[i] * size
    return out


def check_mix(rows, out):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split(None)) if (text or "").isascii() else len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    target, taken, largest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    return target, taken, largest


def test_mixing_by_plain_rounding(docs, rows):
    """Sources of fewer documents than a bucket: the whole result by a plain version."""
    sizes = defaultdict(list)
    for i, text, _, source in rows:
        sizes[source].append((i, len(re.findall("[^\x20\x09-\x0d]+", text or ""))))
    target, want = plain_targets({s: sum(n for _, n in x) for s, x in sizes.items()}), {}
    for s, own in sizes.items():
        want |= plain_copies(own, target[s] / sum(n for _, n in own))
    assert {r["doc_id"]: r["copies"] for r in got(mixing.query(docs))} == want


def test_mixing(docs, rows):
    out = got(mixing.query(docs))
    target, taken, _ = check_mix(rows, out)
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, got(mixing.query(docs))))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    mixed = mixing.resample(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)


def test_mixing_edges(spark, edge, empty):
    out = got(mixing.query(edge))
    check_mix([(r.doc_id, r.text, r.lang, r.source) for r in edge.collect()], out)
    assert len(out) == 10 and mixing.query(empty).count() == 0
    assert mixing.resample(edge).columns == edge.columns and mixing.resample(edge).count() > 0
    many = {f"s{i * 7919 % 997:03d}": int(2 ** (i % 17)) for i in range(500)}
    frame = spark.createDataFrame(list(many.items()), "source string, source_size long")
    assert {r["source"]: pytest.approx(r["target"]) for r in got(mixing.targets(frame, mixing.MixParams()))} == plain_targets(many)
    sources = spark.createDataFrame([("a", 1), ("b", 100), ("c", 50), ("d", 0), (None, 7), ("é", 3)], "source string, source_size long")
    assert {r["source"]: pytest.approx(r["target"]) for r in got(mixing.targets(sources, mixing.MixParams()))} == plain_targets({"a": 1, "b": 100, "c": 50, "d": 0, None: 7, "é": 3})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_merkle(text):
    tree, heads, ends = [], [], []
    for section in text.split("\n\n"):
        nodes = []
        for p in section.split("\n"):
            leaves = [sha(x) for x in (p[:8], p[8:32], p[32:64], *(p[i : i + 64] for i in range(64, len(p), 64))) if x]
            ends += [x[:8] for x in leaves]
            nodes.append((sha("".join(leaves)), len(leaves)))
        heads.append(sha("".join(n for n, _ in nodes)))
        tree.append(heads[-1][:8] + ":" + ",".join(f"{n[:8]}*{k}" for n, k in nodes))
    return sha("".join(heads)) + "|" + ";".join(tree) + "|" + "".join(ends)


def plain_likeness(a, b):
    x, y = ({z[i : i + 8] for i in range(0, len(z), 8)} for z in (a.split("|")[2], b.split("|")[2]))
    return 1.0 if a[:64] == b[:64] else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def plain_edits(ordered):
    out = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        f, e, n = map(plain_merkle, (text, edited, after))
        out.append((i, len(text), sha(edited), f, e, plain_likeness(f, e), plain_likeness(f, n)))
    return Counter(out)


def test_merkle(docs, rows):
    want = plain_edits([(i, t) for i, t, _, _ in sorted(rows, reverse=True)])
    assert flat(merkle.query(docs)) == want


def test_merkle_columns_stay(spark):
    schema = "whole_ string, leaves_ int, paragraphs_ int, sections_ int, place_ int, bucket_ int, edge_ int, to_ int, extra0_ int, doc_id long, text string, next_text string"
    frame = spark.createDataFrame([("w", 1, 2, 3, 4, 5, 6, 7, 8, i, f"text {i}", "n") for i in (3, 1, 2)], schema)
    out = merkle.fingerprint(frame)
    assert out.columns == [*frame.columns, "fingerprint"] and {r[:9] for r in map(tuple, out.collect())} == {("w", 1, 2, 3, 4, 5, 6, 7, 8)}
    out = merkle.with_next(frame, ["text", "leaves_"])
    assert out.columns == [*frame.columns[:-1], "next_text", "next_leaves_"]
    assert {r.doc_id: (r.next_text, r.next_leaves_, *tuple(r)[:9]) for r in out.collect()} == {i: (f"text {j}", 1, "w", 1, 2, 3, 4, 5, 6, 7, 8) for i, j in ((3, 2), (2, 1), (1, 3))}


def test_merkle_sees_what_is_left_of_short_texts(spark):
    frame = spark.createDataFrame([(2, "one short line of text here"), (1, "something else altogether in it")], "doc_id long, text string")
    assert all(0 < r["near_edited"] < 1 and r["near_next"] == 0 for r in got(merkle.query(frame)))


def test_merkle_edges(spark, edge, empty):
    out = got(merkle.query(edge))
    assert len(out) == 10 and merkle.query(empty).count() == 0
    one = spark.createDataFrame([(9, "äöü\n\nx" * 40)], "doc_id long, text string")
    assert flat(merkle.query(one)) == plain_edits([(9, "äöü\n\nx" * 40)])
    blank = spark.createDataFrame([(3, None), (8, ""), (5, "abc")], "doc_id long, text string")
    assert flat(merkle.query(blank)) == plain_edits([(8, ""), (5, "abc"), (3, "")])
    pair = spark.createDataFrame([("a\nb\n\nc\n\nd", "a\nb\n\nX\n\nd")], "a string, b string")
    for c in "ab":
        pair = merkle.fingerprint(pair, c, f"f{c}")
    assert pair.select(merkle.edits(F.col("fa"), F.col("fb"))).first()[0] == [1]


def plain_base(rows):
    token = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", ascii_lower(t)) if w] + [None]
    counts = Counter()
    for i, t in rows:
        if crc_fold(i, 7) != 2:
            counts.update(token(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (crc_fold(i, 7) == 2, len(w := token(t)), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows}


@pytest.mark.parametrize("lookup", [100_000, 50])
def test_lm_scores(docs, rows, lookup):
    want = plain_base([(i, t) for i, t, _, _ in rows])
    params = lmscore.LMParams(lookup=lookup) if lookup > 50 else lmscore.LMParams(lookup=lookup, lookup_bytes=2, flush_bytes=5000)
    out = got(lmscore.query(docs, params))
    assert len(out) == len(rows)
    for r in out:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    if lookup > 50:
        held = [r for r in out if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_is_normalised():
    params = lmscore.LMParams(classes=8, buckets=16)
    rng = np.random.default_rng(0)
    p = rng.random(64)
    model = lmscore.LogBilinear(p / p.sum(), params)
    model.train(rng.integers(0, 64, 5000))
    before = [5, 9, 3]
    total = sum(10 ** model.log10(np.array([*before, y]))[-1] for y in range(64))
    assert total == pytest.approx(1, abs=1e-5)


class PlainLogBilinear(lmscore.LogBilinear):
    """A step that sorts the rows' numbers to add up their gradients."""

    def _plain_move(self, index, **grads):
        order = np.argsort(index.astype(np.uint16), kind="stable")
        rows, first = np.unique(index[order], return_index=True)
        for name, grad in grads.items():
            g = np.add.reduceat(grad(order), first, axis=0)
            self.seen[name][rows] += (g * g).mean(1, keepdims=True)
            self.w[name][rows] -= self.params.rate * g / np.sqrt(self.seen[name][rows])

    def _step(self, x, y):
        w, k, (nc, ni), n = self.w, self.params.classes, self.params.noise, len(y)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        rows = [w["r"][i] for i in x]
        h, cls = sum(r * c for r, c in zip(rows, w["c"])), y % k
        drawn = np.searchsorted(np.cumsum(self.pc), self.rng.random(nc) * self.pc.sum()).clip(0, k - 1)
        own = sigmoid((h * w["qc"][cls]).sum(1) + w["bc"][cls, 0] - self.noise_class[cls]) - 1
        other = sigmoid(h @ w["qc"][drawn].T + w["bc"][drawn, 0] - self.noise_class[drawn])
        noise = self.rng.integers(0, len(self.p) // k, (ni, n)) * k + cls
        items = np.concatenate([y[None], np.where(self.rng.random((ni, n), np.float32) < self.keep[noise], noise, self.other[noise])])
        qi = w["q"][items]
        g = sigmoid((qi * h).sum(2) + w["b"][items, 0] - self.noise_item[items])
        g[0] -= 1
        dh = own[:, None] * w["qc"][cls] + other @ w["qc"][drawn] + (g[:, :, None] * qi).sum(0)
        place, scale, weight = np.stack([(dh * r).sum(0) / n for r in rows]), w["c"].copy(), g.reshape(-1, 1)
        pull, class_pull = np.concatenate([own[:, None] * h, other.T @ h]), np.concatenate([own, other.sum(0)])[:, None]
        self._plain_move(items.ravel(), q=lambda o: weight[o] * h[o % n], b=lambda o: weight[o])
        self._plain_move(np.concatenate([cls, drawn]), qc=lambda o: pull[o], bc=lambda o: class_pull[o])
        self._plain_move(x.ravel(), r=lambda o: dh[o % n] * scale[o // n])
        self._plain_move(np.arange(len(x)), c=lambda o: place[o])


def test_lm_training_is_plain_training_and_takes_less_time():
    params = lmscore.LMParams()
    p = np.arange(1, params.classes**2 + 1) ** -0.5
    ids = np.random.default_rng(3).choice(len(p), 5 * params.batch + 77, p=p / p.sum())
    took = {}
    for _ in range(3):
        models = {kind: kind(p / p.sum(), params) for kind in (lmscore.LogBilinear, PlainLogBilinear)}
        for kind, model in models.items():
            began = time.thread_time()
            model.train(ids)
            took[kind] = min(took.get(kind, math.inf), time.thread_time() - began)
    model, plain = models.values()
    for name in plain.w:
        np.testing.assert_allclose(model.w[name], plain.w[name], atol=2e-5, err_msg=name)
        np.testing.assert_allclose(model.seen[name], plain.seen[name], rtol=1e-3, err_msg=name)
    assert took[lmscore.LogBilinear] < 0.85 * took[PlainLogBilinear]


def test_lm_words_of_arrays(spark):
    params = lmscore.LMParams(flush_words=3, flush_bytes=40)
    words = pa.array([b"a", b"\xff", b"ab", b"abc", "\u00e4".encode(), "na\u00efve".encode(), b"a longer one", b"\x00", b"ab"], pa.binary())
    for some in (words, words.slice(2, 4), words.slice(9)):
        assert lmscore._buckets(some, params).tolist() == [lmscore._bucket(w, params) for w in some.to_pylist()]
    lists = lmscore._by_text(words, np.array([0, 0, 3, 9, 9])).to_pylist()
    assert [sorted((x["word"], x["n"]) for x in t) for t in lists] == [sorted(Counter(words.to_pylist()[a:b]).items()) for a, b in ((0, 0), (0, 3), (3, 9), (9, 9))]
    texts = ["a B a", None, "", " \t", "b c d e f g h", "a " * 50, "i j k l m n o p q r s t u v w x y z", "\u00c4 \u00e4 A\u00a0a"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = Counter(w for t in texts for w in ascii_lower(t or "").encode().split())
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert {bytes(r[0]): r[1] for r in lmscore.count_words(frame, params).collect()} == want
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_lm_edges(edge, empty):
    out = got(lmscore.query(edge))
    assert len(out) == 10 and lmscore.query(empty).count() == 0
    assert [r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]


def plain_templates(line, params=linededup.LineParams()):
    """The line's own template first, then one for each block that may vary."""
    space = "[ \t\n\x0b\x0c\r]+"
    w = [x for x in re.split(space, line) if x]
    if not w:
        return []
    if len(w) < params.min_tokens:
        return [(len(w), *w)]
    w = ["<*>" if re.search("[0-9]", x) else x for x in w]
    out = [(len(w), *w)]
    if len(w) >= params.general:
        rest, d = len(w) - params.depth, params.depth
        cuts = [d + rest * i // params.blocks for i in range(params.blocks + 1)]
        out += [(len(w), i, *w[:a], None, *w[b:]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def plain_recurring(rows, params=linededup.LineParams()):
    """First document of each template that recurs."""
    seen = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            for t in (ts := plain_templates(line, params)):
                seen[t].add((math.inf if i is None else i, ts[0]))
    return {t: min(d for d, _ in s) for t, s in seen.items() if len({d for d, _ in s}) >= params.min_docs and (None not in t or len({o for _, o in s}) > 1)}


def plain_lines(rows, params=linededup.LineParams()):
    first, out = plain_recurring(rows, params), Counter()
    for i, text in rows:
        own = (text or "").split("\n")
        drop = [k for k, line in enumerate(own) if any(first.get(t, math.inf) < (math.inf if i is None else i) for t in plain_templates(line, params))]
        out[(i, len(own) if text is not None else 0, len(drop), ",".join(map(str, drop)), "\n".join(x for k, x in enumerate(own) if k not in drop) if text is not None else None)] += 1
    return out


def test_line_dedup(docs, rows):
    own = [(i, t) for i, t, _, _ in rows]
    want = plain_lines(own)
    assert flat(linededup.query(docs)) == want and any(k[2] for k in want)
    params = linededup.LineParams(depth=1, blocks=3, general=6, min_tokens=2, min_docs=3)
    assert flat(linededup.query(docs, params)) == plain_lines(own, params)


def test_line_dedup_edges(spark, edge, empty):
    out = got(linededup.dedup(edge))
    assert len(out) == 10 and linededup.query(empty).count() == 0 and set(out[0]) == {*edge.columns, "n_lines", "dropped_lines"} and {r["row_"] for r in out} == {"x"}
    assert flat(linededup.query(edge)) == plain_lines([(r.doc_id, r.text) for r in edge.collect()])
    log = [(1, "user 17 logged in\nkeep this one"), (2, "user 99 logged in\nuser 5 logged in"), (3, "the quick brown fox jumps over one lazy dog today\nshort"), (4, "the quick brown fox jumps over two lazy dog today\nshort\n\nno. 7")]
    frame = spark.createDataFrame([(*r, 5, "c") for r in log], "doc_id long, text string, n_lines int, key string")
    kept = linededup.dedup(frame)
    assert sorted(kept.columns) == sorted([*frame.columns, "dropped_lines"])
    assert {r.doc_id: (r.text, r.n_lines, r.key) for r in kept.collect()} == {1: (log[0][1], 2, "c"), 2: ("", 2, "c"), 3: (log[2][1], 2, "c"), 4: ("\nno. 7", 4, "c")}
    shown = {(r.first_doc, r.n_docs, r.n_lines, r.template) for r in linededup.templates(frame).collect()}
    assert shown == {(1, 2, 3, "user <*> logged in"), (3, 2, 2, "the quick brown fox jumps over <*> dog today"), (3, 2, 2, "short")}


def test_line_templates_in_pieces():
    """Hashes do not depend on where a text is cut into pieces, and tell different tokens apart."""
    rng = np.random.default_rng(13)
    data = b"\n".join(b" ".join(b"%d" % x if x % 5 else b"w\xc3\xa9%x" % x for x in rng.integers(0, 50, n)) for n in rng.integers(0, 30, 60)) + b"\n" + b"x" * 500 + b" y\n"
    whole, parts = linededup._tokens(data), linededup._tokens(data, 40)
    assert all((a == b).all() for a, b in zip(whole, parts))
    words = [(i, w) for i, line in enumerate(data.split(b"\n")) for w in line.split()]
    assert whole[2].tolist() == [i for i, _ in words] and whole[1].tolist() == [bool(re.search(rb"[0-9]", w)) for _, w in words]
    assert len(dict(zip((w for _, w in words), whole[0].tolist()))) == len(set(whole[0].tolist()))


def test_one_query_per_operator():
    assert [re.match(r"op(\d+)_", n)[1] for n in QUERIES] == [str(i) for i in range(1, 11)]
