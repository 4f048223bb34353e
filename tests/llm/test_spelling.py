import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from jobloom.llm import queries, spelling_variants

SF = "/root/testdata/sf0.001"


def plain_words(docs, least_length=5, least_count=3, drop_one_in=97):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop_one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def plain_variants(counts, ratio=2):
    """Every near word by wildcards and deletions."""
    holes, near = defaultdict(set), defaultdict(set)
    for word in counts:
        for k in range(len(word)):
            holes[word[:k], word[k + 1 :]].add(word)
    for same in holes.values():
        for word in same:
            near[word] |= same - {word}
    for word in counts:
        for k in range(len(word)):
            if (shorter := word[:k] + word[k + 1 :]) in counts:
                near[word].add(shorter)
                near[shorter].add(word)
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


@pytest.mark.parametrize("region", [spelling_variants.REGION_WORDS, 60])
def test_whole_table_by_brute_force(spark, monkeypatch, region):
    """With one region a length, and with many regions and parts of regions."""
    monkeypatch.setattr(spelling_variants, "REGION_WORDS", region)
    monkeypatch.setattr(spelling_variants, "SAMPLE_WORDS", 500)
    df = queries.QUERIES["op11_spelling_variants"](spark, SF)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = plain_variants(plain_words(docs))
    assert len(expected) > 1000 and any(row[1] for row in expected)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_edits_of_every_kind_and_chains(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "REGION_WORDS", 40)
    rng, counts = random.Random(3), Counter()
    for stem in ("abcdefgh", "aaaaaaaa", "éèêñß中\U0001f600x", "a", "z" * 3000):
        word, n = stem, 4000
        while n:
            counts[word] += n
            n //= 2
            k, how = rng.randrange(len(word) + 1), rng.randrange(3)
            word = word[:k] + rng.choice("abcé中") + word[k + (how > 0) :] if how or len(word) < 2 else word[: k - 1] + word[k:]
    for _ in range(400):
        counts["".join(rng.choice("ab") for _ in range(rng.randrange(4, 9)))] += rng.randrange(1, 50)
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    got = spelling_variants.spelling_variants(rows).collect()
    assert {tuple(r) for r in got} == plain_variants(counts) and len(got) == len(counts)


def test_odd_vocabularies(spark):
    rows = [("house", 5), ("house", 5), ("hause", 5), (None, 9), ("", 9), ("horse", None), ("mouse", 0), ("hous", -3)]
    got = spelling_variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()
    assert {tuple(r) for r in got} == {("house", None, "house", 10, 1, None), ("hause", "house", "house", 5, 1, 10)}
    assert spelling_variants.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="at least 2"):
        spelling_variants.spelling_variants(spark.createDataFrame(rows, "word string, n long"), ratio=1)


def test_odd_documents(spark):
    rows = [(None, "Straße straße STRASSE"), (1, None), (2, ""), (3, "Ärger ärger ÄRGER " * 30_000), (3, "a-b c'd 12345 ŁódŹ"), (4, "naïve " * 4)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling_variants.count_words(docs, least_count=2).collect()}
    assert got == plain_words(rows, least_count=2) and len(got) > 3
    assert spelling_variants.count_words(docs.limit(0)).count() == 0
