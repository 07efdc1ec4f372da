"""Plain versions of operators that SQL cannot express, and texts that are hard on them."""

import itertools
import math
import re
from collections import Counter, defaultdict
from datetime import date, timedelta
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import langid, pii, toxicity

SF = "/root/testdata/sf0.01"


# language identification


def plain_grams(text, params):
    """Buckets of the n-grams of a text, one at a time."""
    mix, codes = (2654435761, 2246822519, 3266489917), [ord(c) for c in text.lower()]
    for i in range(len(codes)):
        h = 17
        for n in range(params.orders):
            if i + n >= len(codes):
                break
            h = ((h ^ codes[i + n]) * mix[n % 3] + n) & 0xFFFFFFFF
            h ^= h >> 15
            yield (h * mix[0] & 0xFFFFFFFF) >> (32 - params.bits)


def plain_bayes(rows, texts, params):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        counts[lang].update(plain_grams(text, params))
        n[lang] += 1
    names, size = sorted(n), 1 << params.bits
    total = {c: sum(counts[c].values()) + params.alpha * size for c in names}
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        grams = list(plain_grams(text, params))
        z = [math.log(n[c] / len(rows)) + sum(math.log((counts[c][g] + params.alpha) / total[c]) for g in grams) for c in names]
        p = [math.exp(v - max(z)) for v in z]
        out.append((names[p.index(max(p))], max(p) / sum(p)))
    return out


def test_language_by_plain_bayes(spark):
    docs = [(r.doc_id, r.text[:400], r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(160).collect()]
    docs += [(9001, "½ ² 12", "en"), (9002, "Ⅻ ① 7", "en"), (9003, "ª", "es"), (9004, None, "fr"), (9005, "12_34", None), (9006, "ß", None)]
    params = langid.LangIdParams(bits=10)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, frame.where("doc_id % 3 <> 0"), params).collect()}
    want = plain_bayes([(la, t) for i, t, la in docs if i % 3 and la and t is not None], [t for _, t, _ in docs], params)
    for (i, _, _), (lang, p) in zip(docs, want):
        assert got[i][0] == lang and got[i][1] == pytest.approx(p, abs=2e-3), i
    assert [got[i][0] for i in (9001, 9002, 9004, 9005)] == ["und"] * 4 and got[9003][0] != "und" and got[9006][0] != "und"


# personal data

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts):
    return sha256("|".join(map(str, parts)).encode()).hexdigest()


def plain_text(s, key, tweak):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, pii.ROUNDS + 1):
        source, moved = digest(key, tweak, i, right), ""
        for j, c in enumerate(left):
            by = int(digest(source, j // 12)[j % 12 * 5 : j % 12 * 5 + 5], 16)
            sort = next((x for x in (DIGITS, LOWER, UPPER) if c in x), None)
            moved += sort[(sort.index(c) + by) % len(sort)] if sort else c
        left, right = right, moved
    return left + right


def plain_number(v, a, b, key, tweak):
    left, right = divmod(v, b)
    for i in range(1, pii.ROUNDS // 2 + 1):
        left = (left + int(digest(key, tweak, i, 0, right)[:12], 16)) % a
        right = (right + int(digest(key, tweak, i, 1, left)[:12], 16)) % b
    return left * b + right


def plain_date(m, key):
    p = [int(x) for x in re.split("[-/.]", m)]
    digits = [len(x) for x in re.split("[-/.]", m)[:2]]

    def exists(y, mo, d):
        try:
            return 1700 <= y < 2100 and bool(date(y, mo, d))
        except ValueError:
            return False

    if digits[0] == 4:
        layout, (y, mo, d), months, days, least = "ymd", p, 12, 31, 1
    elif exists(p[2], p[1], p[0]):
        layout, (d, mo, y), months, days, least = "dmy", p, 9 if digits[1] == 1 else 12, 9 if digits[0] == 1 else 31, 1
    elif "/" in m and p[1] > 12 and exists(p[2], p[0], p[1]):
        layout, (mo, d, y), months, days, least = "mdy", p, 9 if digits[0] == 1 else 12, 19, 13
    else:
        return None
    if not exists(y, mo, d):
        return None
    v = ((y - 1700) * months + mo - 1) * days + d - least
    while True:
        v = plain_number(v, 400, months * days, key, f"date{layout}{months}x{days}")
        y, mo, d = v // (months * days) + 1700, v // days % months + 1, v % days + least
        if exists(y, mo, d):
            break
    if layout == "ymd":
        return f"{y}-{mo:02d}-{d:02d}"
    a, b = (d, mo) if layout == "dmy" else (mo, d)
    sep = "/" if "/" in m else "."
    return f"{a:0{digits[0]}d}{sep}{b:0{digits[1]}d}{sep}{y}"


def refill(m, chars, new):
    new = iter(new)
    return "".join(next(new) if c in chars else c for c in m)


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))


def plain_97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def plain_pseudonym(kind, m, key):
    d = re.sub(r"\D", "", m)
    if kind == "mail":
        head, _, last = m.rpartition(".")
        return plain_text(head, key, "mail") + "." + last
    if kind == "ip":
        if any(int(x) > 255 or x != str(int(x)) for x in m.split(".")):
            return None
        v = plain_number(sum(int(x) << s for x, s in zip(m.split("."), (24, 16, 8, 0))), 65536, 65536, key, "ip")
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        if plain_luhn(d) % 10:
            return None
        body = plain_text(d[:-1], key, f"card{len(d)}")
        return refill(m, DIGITS, body + str(-plain_luhn(body + "0") % 10))
    if kind == "iban":
        s = m.replace(" ", "")
        if len(s) < 15 or plain_97(s) != 1:
            return None
        body = plain_text(s[4:], key, f"iban{s[:2]}")
        return refill(m, DIGITS + UPPER, f"{s[:2]}{98 - plain_97(s[:2] + '00' + body):02d}{body}")
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        v = plain_number(((area - 2 if area > 666 else area - 1) * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        i = v // (99 * 9999)
        return f"{i + 2 if i >= 665 else i + 1:03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"
    if kind == "date":
        return plain_date(m, key)
    return refill(m, DIGITS, d[:-10] + plain_text(d[-10:], key, "phone")) if 8 <= len(d) <= 15 else None


def values(n=60):
    """Valid and other values of each kind."""
    rng = np.random.default_rng(6)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(LOWER[i] for i in rng.integers(0, 26, k))
    out = defaultdict(list)
    start = date(1700, 1, 1)
    for i in range(n):
        out["mail"].append(f"{letters(1 + i % 17)}.{num(i % 4)}@{letters(5)}-{letters(2)}.{letters(3)}.com")
        out["ip"].append(".".join(str(int(x)) for x in rng.integers(0, 256, 4)))
        body = num(12 + i % 7)
        out["card"].append(body + str(-plain_luhn(body + "0") % 10))
        head, own = ("GB", "DE")[i % 2], num(18)
        out["iban"].append(f"{head}{98 - plain_97(head + '00' + own):02d}{own}")
        out["ssn"].append(f"{1 + int(rng.integers(0, 665)):03d}-{1 + i % 99:02d}-{1 + int(rng.integers(0, 9999)):04d}")
        day = start + timedelta(int(rng.integers(0, 146097)))
        y, m, d = day.year, day.month, day.day
        out["date"].append([f"{y}-{m:02d}-{d:02d}", f"{d}/{m}/{y}", f"{d:02d}/{m:02d}/{y}", f"{m:02d}/{d:02d}/{y}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{d:02d}.{m:02d}.{y}"][i % 7])
        out["phone"].append([f"+{1 + i % 40} ({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{1 + i % 9}{num(7 + i % 8)}"][i % 3])
    out["card"].append("4111 1111 1111 1112")
    out["ip"] += ["300.1.1.1", "010.1.1.1", "0.0.0.0", "255.255.255.255"]
    out["date"] += ["30/2/2000", "2/30/2000", "2001-13-40", "29/02/2000", "29/02/2001", "31.04.1999", "01/01/1699", "12/31/2099", "00/01/2000"]
    out["ssn"] += ["000-12-3456", "666-12-3456", "665-99-9999", "899-99-9999", "900-10-1000"]
    out["iban"].append("GB83 WEST 1234 5698 7654 32")
    return out


@pytest.mark.parametrize("kind", list(pii.KINDS))
def test_pseudonyms_by_plain_feistel(spark, kind):
    own = values()[kind]
    frame = spark.createDataFrame([(i, f"x {v} y") for i, v in enumerate(own)], "doc_id long, text string")
    got = {r.doc_id: (r.text, [(p.kind, p.place, p.pseudonym) for p in r.pii]) for r in pii.pseudonyms(frame, "key").collect()}
    for i, v in enumerate(own):
        want = plain_pseudonym(kind, v, "key")
        assert got[i] == (f"x {want or v} y", [(kind, 0, want)] if want else []), v
    moved = [p[0][2] for _, p in got.values() if p]
    assert len(set(moved)) == len({v for v, (_, p) in zip(own, got.values()) if p}) > 40


def test_dates_of_all_layouts_stay_apart(spark):
    """Of all days of some years in all layouts, different strings have different pseudonyms of the same shape."""
    days = spark.sql("SELECT explode(sequence(date'1999-01-01', date'2000-12-31')) AS d")
    texts = [days.select(F.date_format("d", f).alias("s")) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "d/M/yyyy", "M/d/yyyy", "dd.MM.yyyy", "d.M.yyyy")]
    every = texts[0]
    for t in texts[1:]:
        every = every.union(t)
    rows = [tuple(r) for r in every.distinct().select("s", pii._date(F.col("s"), "k")).collect()]
    assert len({p for _, p in rows}) == len(rows) > 4000
    assert all(re.sub(r"\d", "9", s) == re.sub(r"\d", "9", p) for s, p in rows)


def test_number_permutations_hit_every_place(spark):
    for a, b in ((9, 81), (40, 12 * 19), (1, 7)):
        moved = [r[0] for r in spark.range(a * b).select(pii.permute_number(F.col("id"), a, F.lit(b), "k", F.lit("t"))).collect()]
        assert sorted(moved) == list(range(a * b))


def test_pii_hard_texts(spark):
    hard = ["x@a" + ".a" * 20_000, "a." * 40_000, "1-" * 40_000, "1/1/" * 20_000, "7" * 300_000, "ann@" * 20_000, "+1 " * 30_000, "1." * 40_000, "GB82 " * 20_000]
    out = {r.doc_id: (r.text, r.n_replaced) for r in pii.query(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).collect()}
    assert [n for _, (_, n) in sorted(out.items())] == [1] + [0] * 8
    assert len(out[0][0]) == len(hard[0]) and out[0][0].endswith(".a") and all(out[i][0] == hard[i] for i in range(1, 9))


def test_pii_edges(spark):
    schema = "finds_ string, kinds_ int, moved_ string, pii string, extra1_ string, doc_id long, text string"
    rows = [("f", 1, "m", "p", "e", i, t) for i, t in ((1, None), (2, ""), (3, "ip 10.0.0.1"), (3, "ip 10.0.0.1"), (None, "ip 10.0.0.1"))]
    frame = spark.createDataFrame(rows, schema)
    out = pii.pseudonyms(frame, "k")
    assert out.columns == ["finds_", "kinds_", "moved_", "extra1_", "doc_id", "text", "pii"]
    got = sorted(out.collect(), key=lambda r: (r.text or "", r.doc_id or 0))
    assert all((r["finds_"], r["kinds_"], r["moved_"], r["extra1_"]) == ("f", 1, "m", "e") for r in got)
    assert len(got) == 5 and len({r.text for r in got}) == 3 and [len(r.pii) for r in got] == [0, 0, 1, 1, 1]
    assert pii.query(frame.limit(0)).count() == 0


# toxicity


def sentence(rng, n, *more, words=300, prefix="w"):
    out = [f"{prefix}{i}" for i in rng.integers(0, words, n)]
    for m in more:
        at = int(rng.integers(0, len(out) + 1))
        out[at:at] = m.split()
    return " ".join(out).encode()


def test_short_texts_are_learned():
    """Fourteen tokens are fewer than a window has."""
    rng = np.random.default_rng(8)
    rows = [(int(i % 4 == 0), sentence(rng, 13, "vile" if i % 4 == 0 else "fine")) for i in range(400)]
    crf = toxicity.fit(rows, toxicity.ToxicityParams())
    assert (crf.scores([sentence(rng, 13, "vile") for _ in range(50)]) > 0.5).all()
    assert (crf.scores([sentence(rng, 13, "fine") for _ in range(50)]) < 0.5).all()
    assert crf.scores([b""])[0] < 0.5


def test_smaller_language_is_learned():
    rng = np.random.default_rng(9)
    rows = [(0, sentence(rng, 60)) for _ in range(500)] + [(1, sentence(rng, 60, "vile")) for _ in range(120)]
    rows += [(0, sentence(rng, 60, prefix="mot")) for _ in range(120)] + [(1, sentence(rng, 60, "vilain", prefix="mot")) for _ in range(12)]
    crf = toxicity.fit(rows, toxicity.ToxicityParams())
    assert (crf.scores([sentence(rng, 40, "vilain", prefix="mot") for _ in range(30)]) > 0.5).all()
    assert (crf.scores([sentence(rng, 40, prefix="mot") for _ in range(30)]) < 0.5).all()


def test_long_text_of_many_places_and_spans():
    rng = np.random.default_rng(10)
    rows = [(0, sentence(rng, 60)) for _ in range(300)] + [(1, sentence(rng, 60, "vile")) for _ in range(80)] + [(1, b"vile word " * 4000)]
    crf = toxicity.fit(rows, toxicity.ToxicityParams())
    text = "w1 w2 W3, Vile! w4 — vile w5".encode()
    assert [text[a:b].lower() for a, b in crf.spans(text)] == [b"vile", b"vile"]
    assert toxicity.ToxicCRF(crf.words, crf.emission, crf.a, crf.start, crf.head, toxicity.ToxicityParams(block_tokens=5)).scores([text, b"w1 w2"]) == pytest.approx(crf.scores([text, b"w1 w2"]))


def test_crf_training_climbs_the_likelihood():
    """The likelihood by enumeration grows, and its gradient at the end is small."""
    rng = np.random.default_rng(12)
    windows = []
    for _ in range(60):
        n = int(rng.integers(1, 6))
        x = rng.integers(0, 5, n)
        windows.append((x, ((x == 4) | (rng.random(n) < 0.1)).astype(int), float(rng.choice([0.5, 1.0]))))

    def likelihood(e, tr, st):
        out = 0.0
        for x, t, w in windows:
            score = lambda s: st * s[0] + sum(e[i] for i, v in zip(x, s) if v) + sum(tr[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
            out += w * (score(t) - math.log(sum(math.exp(score(s)) for s in itertools.product((0, 1), repeat=len(x)))))
        return out / sum(w for _, _, w in windows)

    found = toxicity._train(windows, 5, 400, block=7)
    e, tr, st = found[0], np.log(found[1]), math.log(found[2])
    best = likelihood(e, tr, st)
    assert best > likelihood(np.full(5, -3.0), np.zeros((2, 2)), -3.0) + 0.3
    for i in range(5):
        step = np.eye(5)[i] * 1e-3
        assert abs(likelihood(e + step, tr, st) - likelihood(e - step, tr, st)) / 2e-3 < 0.02
    one, other = toxicity._train(windows, 5, 20, block=7), toxicity._train(windows, 5, 20, block=1000)
    assert np.allclose(one[0], other[0])


def test_document_scores_by_enumeration():
    a, start = np.array([[1.0, 0.2], [0.5, 2.0]]), 0.3
    emission, head = np.array([-1.0, 2.0, 0.5]), np.array([-2.0, 3.0, 0.7])
    crf = toxicity.ToxicCRF({b"x": 1, b"y": 2}, emission, a, start, head, toxicity.ToxicityParams(block_tokens=4))
    texts, want = [b"x y other", b"Y, y: x", b"", b"other", b"x other y x"], []
    for text in texts:
        ids, z = [crf.words.get(t, 0) for t in toxicity.tokens(text)], 0.0
        z = np.zeros(len(ids) + 1)
        for path in itertools.product((0, 1), repeat=len(ids)):
            w = (start if path[0] else 1.0) if path else 1.0
            for p, q in zip(path, path[1:]):
                w *= a[p, q]
            z += w * math.exp(sum(emission[i] for i, s in zip(ids, path) if s)) * np.array([*path, 1])
        m = z[:-1] / z[-1]
        want.append(1 / (1 + math.exp(-(head[0] + head[1] * m.max(initial=0.0) + head[2] * math.log1p(m.sum())))))
    assert crf.scores(texts) == pytest.approx(want)
