import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from jobloom.llm import language_id, queries
from jobloom.llm.textvec import mix

SF = "/root/testdata/sf0.01"


def plain_ngrams(text):
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
    chars = [32, *(ord(c) for c in " ".join(words)), 32]
    if not any(c.isalpha() for c in text or ""):
        return {}
    found = Counter()
    for order in range(1, language_id.ORDERS + 1):
        for k in range(len(chars) - order + 1):
            total = order + sum(chars[k + j] * int(language_id._PLACE[j]) for j in range(order))
            hashed = mix(np.array([total & (2**64 - 1)], dtype=np.uint64))[0] >> np.uint64(64 - language_id.BITS)
            found[int(hashed)] += 1
    return dict(found)


@pytest.mark.parametrize("text", [None, "", "12 - 3!", "a", "  Straße, naïve; ÉCOLE 中文 हिन्दी\n", "x" * 50, "ab cd " * 40, "é"])
def test_ngrams_equal_plain_python(monkeypatch, text):
    for piece in (language_id.PIECE, 16):
        monkeypatch.setattr(language_id, "PIECE", piece)
        place, count = language_id.ngrams(text)
        assert dict(zip(place.tolist(), count.tolist(), strict=True)) == plain_ngrams(text)
        assert (np.diff(place) > 0).all()


def plain_ftrl(rows, labels, classes):
    """Coordinate by coordinate."""
    import math

    a, b, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z, n = Counter(), Counter()
    bz, bn = [0.0] * classes, [0.0] * classes

    def weight(key):
        if abs(z[key]) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((b + math.sqrt(n[key])) / a + l2)

    for epoch in range(language_id.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            place, value = rows[k]
            bias = [-bz[c] / ((b + math.sqrt(bn[c])) / a) for c in range(classes)]
            w = {(p, c): weight((p, c)) for p in place.tolist() for c in range(classes)}
            sums = [bias[c] + sum(w[p, c] * v for p, v in zip(place.tolist(), value.tolist(), strict=True)) for c in range(classes)]
            top = max(sums)
            p_ = [math.exp(s - top) for s in sums]
            for c in range(classes):
                error = p_[c] / sum(p_) - (labels[k] == c)
                for p, v in zip(place.tolist(), value.tolist(), strict=True):
                    g = error * v
                    z[p, c] += g - (math.sqrt(n[p, c] + g * g) - math.sqrt(n[p, c])) / a * w[p, c]
                    n[p, c] += g * g
                bz[c] += error - (math.sqrt(bn[c] + error * error) - math.sqrt(bn[c])) / a * bias[c]
                bn[c] += error * error
    return {key: weight(key) for key in z}, [-bz[c] / ((b + math.sqrt(bn[c])) / a) for c in range(classes)]


def test_updates_equal_plain_python():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(60)]
    labels = rng.integers(0, 3, 60)
    w, bias = language_id.fit_ftrl(rows, labels, 3, 12)
    expected, expected_bias = plain_ftrl(rows, labels, 3)
    assert all(abs(w[p, c] - v) < 1e-9 for (p, c), v in expected.items()) and np.allclose(bias, expected_bias)


def test_temperature_brings_confidence_back():
    rng = np.random.default_rng(8)
    sums = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language_id.softmax(sums)])
    assert abs(language_id.fit_temperature(sums * 5, labels) - 5) < 0.8
    assert abs(language_id.fit_temperature(sums / 4, labels) - 0.25) < 0.05


def test_whole_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert len(tested) > 250 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in tested]) >= 0.97


SPOKEN = {"one": "thon er ing wh oul st ed", "two": "éa ou eux ç ment tre èr", "three": "sch ung keit ß pf ä ver"}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SPOKEN[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, spoken(rng, lang, 30), lang) for k in range(300) for lang in [list(SPOKEN)[k % 3]]]
    same = [(0, rows[0][1], rows[0][2])] * 500
    odd = [(1000, None, "one"), (1001, "", "two"), (1002, "12 34 — !", "one"), (1003, spoken(rng, "two", 60_000), None), (None, rows[1][1], "one"), (1, rows[1][1], "two")]
    held = [k for k in range(2000, 2400) if zlib.crc32(str(k).encode()) % 3 == 1]
    odd += [(k, spoken(rng, "three", 30), "wrong") for k in held]  # held out: must not teach
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows + same + odd, schema)
    docs = docs.selectExpr("*", "'clash' AS score", "1 AS lang_pred")
    got = language_id.identify_languages(docs).collect()
    assert len(got) == len(rows) + len(same) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert {(by_id[k].lang_pred, by_id[k].score) for k in (1000, 1001, 1002)} == {("und", 0.0)}
    assert by_id[1003].lang_pred == "two" and by_id[None].lang_pred == by_id[1].lang_pred and by_id[None].held_out is False
    assert all(by_id[k].lang_pred == "three" and by_id[k].held_out for k in held)
    assert language_id.identify_languages(docs.limit(0)).count() == 0
    unlearned = language_id.identify_languages(spark.createDataFrame([(1, "text", None)], schema)).first()
    assert (unlearned.lang_pred, unlearned.score) == ("und", 0.0)


def test_the_sample_is_bounded(spark):
    rng = random.Random(6)
    rows = [(k, spoken(rng, lang, 10), lang) for k in range(400) for lang in [list(SPOKEN)[k % 3]]] + [(7, "thon er", "one")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(language_id.teaching_rows(docs), 10, 25).collect()
    assert len(sample) <= 25 and len({r.h for r in sample}) == len(sample)
    assert max(Counter(r.lang for r in sample).values()) <= 10
    assert language_id.train_languages(docs, 10, 25).languages == sorted(SPOKEN)
