import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from jobloom.llm import lexical_search, queries
from jobloom.llm.lexical_search import K2Treap

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def plain_ranks(docs, items, k=50):
    """Every document scored for every item."""
    counted = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(term for _, c in counted for term in c)
    got = set()
    for item_id, text in set(items):
        scored = []
        for (doc_id, c), n in zip(counted, sizes, strict=True):
            score = 0
            for term in set(plain_terms(text)) & c.keys():
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += weight * ((1000000000 * c[term]) // (1000 * c[term] + 20 * m))
            if score:
                scored.append((-score, doc_id is None, doc_id))
        got |= {(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scored)[:k], 1)}
    return got


@pytest.mark.parametrize("seed", range(60))
def test_treap_finds_what_a_scan_finds(seed):
    rng = np.random.default_rng(seed)
    grid = np.where(rng.random(shape := rng.integers(1, 70, 2)) < rng.random(), rng.integers(1, 20, shape), 0)
    row, col = np.nonzero(grid)
    treap = K2Treap.build(row, col, grid[row, col])
    assert len(treap.children) == len(row)  # a node a cell
    rows, k = np.unique(rng.integers(0, shape[0], rng.integers(1, 8))), int(rng.integers(1, 12))
    weights = rng.integers(1, 10, len(rows))
    scores = weights @ grid[rows]
    bar = sorted(scores, reverse=True)[:k][-1]
    got = dict(zip(*map(np.ndarray.tolist, treap.best(rows, weights, k)), strict=True))
    assert got == {c: s for c, s in enumerate(scores.tolist()) if s >= max(1, bar)}


@pytest.mark.parametrize("block", [(1 << 14, 2_000_000), (7, 500)])
def test_whole_tables_by_brute_force_and_sql(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block[0])
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block[1])
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    got = queries.QUERIES["op12_lexical_search"](spark, SF).select("item_id", "rank", "doc_id", "score").collect()
    expected = plain_ranks(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 100
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    assert set(con.execute(queries.ORACLE_SQL["op12_lexical_search"]).fetchall()) == expected


def test_a_task_holds_few_blocks_of_the_index(spark, monkeypatch):
    """What a file holds together is bounded by bytes, however many blocks a task writes; readers hold it whole."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from jobloom.sources import scratch

    monkeypatch.setattr(scratch, "ROW_GROUP_BYTES", 1 << 16)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 4000)
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(1000))) for k in range(240)], "doc_id long, text string").coalesce(1)
    index = lexical_search.build_index(docs, lexical_search.count_corpus(docs))
    groups = [g for f in Path(index._scratch_path.removeprefix("file:")).glob("*.parquet") for g in [pq.ParquetFile(f).metadata] for g in map(g.row_group, range(g.num_row_groups))]
    assert sum(g.num_rows for g in groups) == index.count() == 60
    assert max(g.num_rows for g in groups) <= 2 and max(g.total_byte_size for g in groups) < 1 << 18


def test_odd_rows(spark, monkeypatch):
    """Ties, repeated and null ids, empty and very long texts, other scripts, clashing columns, several groups of items."""
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 60)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 1000)
    rng = random.Random(5)
    docs = [(k % 40, " ".join(rng.choice("red blue green naïve 中文 ΣΑΣ x1".split()) for _ in range(rng.randrange(1, 12)))) for k in range(150)]
    docs += [(None, "red, BLUE"), (None, None), (1000, ""), (1001, "!?"), (1002, "red " * 200_000), (1003, "red"), (1003, "red")]
    items = [(1, "Red-blue (GREEN)"), (1, "Red-blue (GREEN)"), (2, "naïve 中文"), (None, "x1?"), (3, None), (4, ""), (5, "absent"), (6, "red " * 50), (7, "σας ΣΑΣ")]
    left = spark.createDataFrame([(*r, "clash", 3) for r in docs], "doc_id long, text string, score string, item_id int")
    right = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    for k in (3, 50):
        got = lexical_search.rank_documents(left, right, k).select("item_id", "rank", "doc_id", "score").collect()
        expected = plain_ranks(docs, items, k)
        assert {tuple(r) for r in got} == expected and len({(r.item_id, r.rank) for r in got}) == len(got)
    assert lexical_search.rank_documents(left.limit(0), right).count() == 0
    assert lexical_search.rank_documents(left, right.limit(0)).count() == 0
