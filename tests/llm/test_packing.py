import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobloom.llm import packing, sharding, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def fewest(items, capacity):
    """Fewest bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[k]:
                rest = list(bins)
                rest.remove(room)
                place(k + 1, rest + [room - items[k]])
        place(k + 1, bins + [capacity - items[k]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(120):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        count = dict(Counter(items))
        fixed = packing.reduce_by_dominance(count, 20)
        left = [w for w, n in count.items() for _ in range(n)]
        assert all(sum(lengths) <= 20 for lengths, _ in fixed)
        assert sum(t for _, t in fixed) + (fewest(left, 20) if left else 0) == fewest(items, 20)


def test_plan_places_everything_once():
    rng = random.Random(5)
    for most in (50, 1, 3):
        histogram = {w: rng.randrange(1, most + 1) for w in rng.sample(range(1, 101), 40)}
        taken, filled = defaultdict(list), defaultdict(list)
        for run in packing.plan(histogram, 100):
            taken[run.length] += range(run.lo, run.hi)
            for k in range(run.hi - run.lo):
                filled[run.sequence + k].append((run.offset, run.length))
        assert {w: sorted(r) for w, r in taken.items()} == {w: list(range(n)) for w, n in histogram.items()}
        for parts in filled.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 100
        assert len(filled) <= 1.25 * -(-sum(w * n for w, n in histogram.items()) // 100) + 1


def test_token_ids_equal_the_tokenizer():
    rng = random.Random(3)
    alphabet = ["'", "'s", "'re", "'ll", "'d", "a", "Bc", " ", "  ", "\n", " \n", "\t", "12", "3", ".", "!!", "é", "中", " ",
                "　", "'T", "’", "<|endoftext|>", "\U0001f600", "ั", "½", "͸", "_", "\r\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000)]
    plain = Tokenizer.from_file(PATH)
    got = tokens.WordTokenizer(PATH).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "long words " * 9000), (None, "x"), (0, "again"), (0, "again")], docs.schema)
    docs = docs.unionByName(extra).selectExpr("*", "1 as rank", "2 as length", "'x' as sequence_id")
    rows = packing.pack(docs, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    expected = Counter()
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        start, piece = 0, 0
        while start < len(ids):
            size = (len(ids) - start) % 2048 or 2048
            expected[r.doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            start, piece = start + size, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        assert all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts)))
        assert sum(n for _, n in parts) <= 2048
    assert len(filled) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_tightest_bin_tree():
    rng = random.Random(1)
    tree, held = sharding.Capacities(), set()
    for k in range(3000):
        if held and rng.random() < 0.4:
            key = rng.choice(sorted(held))
            tree.remove(key)
            held.remove(key)
        else:
            key = (rng.randrange(500), k)
            tree.add(key)
            held.add(key)
        size = rng.randrange(520)
        assert tree.tightest(size) == min((h for h in held if h[0] >= size), default=None)
    assert tree.root[3] < 20


def plain_best_fit(sizes, capacity, most):
    """Loads of the bins if each size, largest first, enters the fullest bin that has room."""
    loads = []
    for size in sorted(sizes, reverse=True):
        room = [k for k, load in enumerate(loads) if load + size <= capacity]
        if room:
            loads[max(room, key=lambda k: loads[k])] += size
        elif len(loads) == most or size > capacity:
            return None
        else:
            loads.append(size)
    return sorted(loads)


def test_shard_plan_is_best_fit_decreasing_over_all_groups():
    rng = random.Random(3)
    for case in range(60):
        sizes = [rng.choice((8, 9, rng.randrange(8, 60), rng.randrange(8, 400))) for _ in range(rng.randrange(1, 300))]
        sizes += [3000] * (case % 3)
        shards = rng.randrange(1, 9)
        count = Counter(sizes)
        runs, loads, ranks = sharding.plan(dict(count), shards), Counter(), defaultdict(list)
        for r in runs:
            loads[r.shard] += r.size * (r.hi - r.lo)
            ranks[r.size] += range(r.lo, r.hi)
        assert all(sorted(ranks[size]) == list(range(n)) for size, n in count.items())
        assert set(loads) <= set(range(shards))
        alone = [size for k, size in enumerate(sorted(sizes, reverse=True)) if loads[k] == size and size * (shards - k) >= sum(sorted(sizes, reverse=True)[k:])]
        if not alone:
            capacity = max(loads.values())
            least = max(-(-sum(sizes) // shards), max(sizes))
            assert sorted(loads.values()) in [plain_best_fit(sizes, c, shards) for c in range(max(least, capacity), capacity + 1 + max(sizes))]
            assert capacity <= least + max(sizes)
    assert sharding.plan({}, 4) == []


def test_numbers_of_a_large_key_are_gapless(spark, monkeypatch):
    from jobloom.llm import numbering

    monkeypatch.setattr(numbering, "ROWS_PER_GROUP", 50)
    for limit in (500_000, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(numbering, "BROADCAST_ROWS", limit)
        df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id % 40) as k", "cast(1 + id % 2 as int) as w")
        got = numbering.gapless(df, ["k"], ["id"], "nth").groupBy("k").agg(F.sort_array(F.collect_list("nth")).alias("all")).collect()
        assert all(r["all"] == list(range(len(r["all"]))) for r in got) and len(got) == 40
        got = numbering.gapless(df, ["k"], ["id"], "at", weight="w").collect()
        places = defaultdict(list)
        for r in got:
            places[r.k] += range(r["at"], r["at"] + r.w)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def check_shards(spark, rows, shards):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, slot int")
    got = sharding.shard_documents(df, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots, size, of = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    return [size[k] for k in range(shards)]


def test_shards_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (None, "x"), (0, rows[0][1]), (0, rows[0][1])]
    sizes = check_shards(spark, rows, 4)
    assert max(sizes) - min(sizes) <= 0.02 * max(sizes)


def test_a_text_with_a_third_of_all_bytes_keeps_a_shard(spark):
    rows = [(k, "hot text " * 4) for k in range(300)] + [(1000 + k, f"text {k} " * 4) for k in range(700)]
    sizes = sorted(check_shards(spark, rows, 8))
    assert sizes[-2] - sizes[0] <= 0.05 * sizes[-2]
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sequences_hold_their_ids(spark):
    texts = {1: "some words here", 2: "long words " * 1500, 3: "", None: "no id", 4: "again"}
    rows = [*texts.items(), (4, "again")]
    plain = Tokenizer.from_file(PATH)
    ids = {k: [*plain.encode(text, add_special_tokens=False).ids, 0] for k, text in texts.items()}
    made = packing.sequences(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    found = Counter()
    for r in made:
        assert len(r.ids) == sum(x.length for x in r.pieces) <= 2048
        for x in r.pieces:
            assert r.ids[x.offset : x.offset + x.length] == ids[x.doc_id][x.start : x.start + x.length]
            found[x.doc_id] += x.length
    assert found == Counter({k: len(v) * (2 if k == 4 else 1) for k, v in ids.items()})


def test_shards_hold_their_rows(spark):
    rows = [(k % 50 or None, f"text {k}", k) for k in range(200)] + [(1, None, 7), (1, None, 7)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 4).collect()
    assert Counter(tuple(r.row) for r in got) == Counter(rows)
    assert len({(r.shard, r.slot) for r in got}) == len(rows) and {r.shard for r in got} == {0, 1, 2, 3}
