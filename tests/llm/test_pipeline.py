"""The pipeline against plain versions of all its stages, and on rows at the edges."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_operators import leaks, plain_copies, plain_simhash, plain_targets, token_rows

from tabloom.llm import toxicity

SF = "/root/testdata/sf0.01"
WORDS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def size(text):
    return len([w for w in "".join(" " if c in WORDS else c for c in text or "").split(" ") if w])


def plain_stages(docs, labels, items):
    """Rows (doc_id, text, source) after each stage but the last, by plain loops."""
    rows = sorted(docs)
    toxic = defaultdict(int)
    for i, t in labels:
        toxic[i] = max(toxic[i], int(t > 0))
    crf = toxicity.fit([(toxic[i], t.encode()) for i, t, _ in rows if i in toxic], toxicity.ToxicityParams())
    scores = crf.scores([(t or "").encode() for _, t, _ in rows])
    yield (rows := [r for r, p in zip(rows, scores) if p < 0.5])
    first = {c for _, _, c in plain_simhash([(i, t) for i, t, _ in rows])}
    yield (rows := [r for r in rows if r[0] in first])
    hit = {k[0] for k in leaks([(i, t) for i, t, _ in rows], items) if k[5]}
    yield (rows := [r for r in rows if r[0] not in hit])
    by_source = defaultdict(list)
    for i, t, s in rows:
        by_source[s].append((i, size(t)))
    target, copies = plain_targets({s: sum(n for _, n in x) for s, x in by_source.items()}), {}
    for s, own in by_source.items():
        copies |= plain_copies(own, target[s] / sum(n for _, n in own))
    yield [r for r in rows for _ in range(copies[r[0]])]


def test_stages_and_run_by_plain_versions(spark, docs, tokenizer, tmp_path):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    wants = list(plain_stages(rows, labels, items))
    assert len(rows) > len(wants[0]) > len(wants[1]) > len(wants[2])
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        assert Counter((r.doc_id, r.text, r.source) for r in now.collect()) == Counter(want), name
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert Counter(map(tuple, out.collect())) == token_rows([(i, t) for i, t, _ in wants[-1]], tokenizer)


def test_stages_at_the_edges(spark, tmp_path):
    """Null, empty, long and repeated texts, null and repeated ids, null sources, a clashing column; and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double"
    long = "word " * 20_000 + "end"
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "nobody here at all", "en", "b"), (None, None, None, "b"), (3, long, "en", "a"), (4, long, "en", "b"), (5, "one text", "en", "a"), (5, "one text", "en", "a"), (5, "another sort of text", "en", "c")]
    frame = spark.createDataFrame([(*r, 7, 0.5) for r in rows], schema)
    for start in (frame, frame.limit(0)):
        now = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{k}-{start is frame}"
            stage(spark, now, SF).write.parquet(path)
            after = spark.read.parquet(path)
            if name != "token_ids":
                assert after.columns == frame.columns and (not now.count() or {(r.n_chars, r.toxicity) for r in after.collect()} <= {(7, 0.5)})
                now = after
        assert after.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and after.count() == now.count()
        if start is frame:
            texts = {(r.doc_id, r.text) for r in now.collect()}
            assert texts <= {(i, t) for i, t, *_ in rows} and {(None, "nobody here at all"), (5, "another sort of text")} <= texts and (4, long) not in texts
