import random
import re

import numpy as np
import pytest

from jobloom.llm import embedding_dedup, minhash_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if len(words) >= 5 else {tuple(words)}


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    order = components(len(rows), linked)
    least = {}
    for k, c in enumerate(order):
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return {rows[k][0]: (len(sets[k]), least[order[k]]) for k in range(len(rows))}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.minhash_components(df).collect()}
    assert got == brute(rows)


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_minhash_equals_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("small", [2, 24])
def test_minhash_near_the_threshold(spark, monkeypatch, small):
    """Copies whose similarity lies around the threshold, through the pairwise and the block path."""
    monkeypatch.setattr(minhash_dedup, "SMALL_KEY", small)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    texts = near_copies(60, 120, 2, 1) + near_copies(40, 80, 1, 2) + near_copies(40, 90, 3, 3)
    check(spark, list(enumerate(texts, start=5)))


def test_minhash_corner_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"),
            (7, "é ü"), (8, "É ü"), (9, "word " * 20000), (10, "word " * 3 + "word word"), (None, "one two"), (4, "one two")]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, component_id int, kept string")
    got = minhash_dedup.minhash_components(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[2].component_id == 2
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert by[8].component_id == 8 and by[10].component_id == 9 and by[9].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    kept = minhash_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert minhash_dedup.minhash_components(df.limit(0)).count() == 0


def test_unlike_texts_of_a_repeated_id_stay(spark):
    near = near_copies(3, 100, 1, 4)
    rows = [(1, near[0]), (1, "another text of five words"), (1, near[0]), (2, near[1]), (2, "last words"), (3, near[2]), (1, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.component_id, r.n_shingles) for r in minhash_dedup.minhash_components(df).collect()}
    assert (2, 2, 1, 96) in got and (2, 2, 2, 1) in got and (3, 3, 1, 96) in got
    kept = [(r.doc_id, r.text) for r in minhash_dedup.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[1], rows[4], rows[6], rows[7]], key=str)


def test_one_component_in_blocks_of_its_own(spark, monkeypatch):
    """A large group of near copies meets others under shared keys, but not itself again."""
    monkeypatch.setattr(minhash_dedup, "SMALL_KEY", 2)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = random.Random(9)
    base = near_copies(1, 100, 0, 8)[0].split()
    texts = near_copies(1, 100, 0, 8) * 1
    for k in range(60):
        copy, edits = list(base), 1 if k < 40 else 6
        for _ in range(edits):
            copy[rng.randrange(100)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    check(spark, list(enumerate(texts)))


def test_blocks_meet_texts_without_a_broadcast(spark, monkeypatch):
    """Rows of meeting blocks grow with the square of a family and shrink a hundredfold in a file."""
    monkeypatch.setattr(minhash_dedup, "SMALL_KEY", 2)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    plans = {}

    def planned(df, name, write=minhash_dedup.materialize):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(minhash_dedup, "materialize", planned)
    check(spark, list(enumerate(near_copies(40, 80, 1, 2) + near_copies(40, 90, 3, 3))))
    assert "BroadcastHashJoin" not in plans["block-links"][1] and "strategy=merge" in plans["block-links"][0]
    assert "strategy=merge" in plans["dealt"][0]


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base, base[:30] + 0.2 * rng.normal(size=(30, 32)), base[:10], base[:5] * 3])
    rows = [(k, [float(a) for a in v], 0) for k, v in enumerate(x)]
    extra = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [1.0] * 31 + [None], 1),
             (904, [float("inf")] * 32, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>, cid int")
    got = {r.vec_id: r for r in embedding_dedup.embedding_components(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    root = components(len(u), zip(*np.nonzero(links), strict=True))
    found = sum(got[k].n_links for k in range(len(u)))
    assert found >= 0.9 * links.sum()
    assert all(got[k].n_links == links[k].sum() and got[k].component_id == root[k] for k in range(len(u)))
    for k in (900, 901, 902, 903, 904, 905):
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept
    assert got[907].component_id == 906 and got[906].n_links == 1
    assert got[None].n_links == 0 and got[None].kept
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_embedding_recall_on_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = int(((u @ u.T) >= 0.95).sum() - len(u))
    got = sum(r.n_links for r in embedding_dedup.embedding_components(df).collect())
    assert links * 0.9 <= got <= links


@pytest.mark.parametrize(("long", "n_pivots", "dimension", "clusters"), [(1000, 64, 64, 0), (10, 64, 64, 0), (10, 2048, 256, 0), (30, 2048, 64, 6), (30, 64, 64, 6)])
def test_embedding_lists(spark, monkeypatch, long, n_pivots, dimension, clusters):
    """Recall at the threshold, with lists that are split by a second pivot and in several blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "LONG", long)
    monkeypatch.setattr(embedding_dedup, "pivots_for", lambda n: n_pivots)
    rng = np.random.default_rng(6)
    a = rng.normal(size=(300, dimension))
    if clusters:
        a = rng.normal(size=(clusters, dimension))[rng.integers(0, clusters, 300)] + 0.5 * a
    a /= np.linalg.norm(a, axis=1)[:, None]
    noise = rng.normal(size=(300, dimension))
    noise -= (noise * a).sum(1)[:, None] * a
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cosine = 0.955
    b = cosine * a + np.sqrt(1 - cosine**2) * noise
    x = np.concatenate([a, b])
    rows = [(k, [float(q) for q in v]) for k, v in enumerate(x)]
    got = embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    links = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    assert 0.9 * links.sum() <= sum(r.n_links for r in got) <= links.sum()
    assert all(r.n_links <= links[r.vec_id].sum() for r in got)


def test_number_of_pivots():
    assert [embedding_dedup.pivots_for(n) for n in (0, 10_000, 51_200, 204_800, 10**9)] == [64, 128, 512, 2048, 32768]
