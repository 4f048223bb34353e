"""Stages of the corpus pipeline, replayed by plain Python on the whole input of each, and with odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobloom.llm import queries, toxicity
from jobloom.llm.scratch import materialize
from test_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark):
    stages, texts = dict(corpus_pipeline.STAGES), lambda df: {r.doc_id: r.text for r in df.collect()}
    docs = queries.table(spark, SF, "documents")
    before = texts(docs)
    lexicon = toxicity.learn_lexicon(docs, queries.table(spark, SF, "labels"))
    found = lexicon.automaton()

    def score(text):
        folded = toxicity.fold(text)
        z = toxicity.density(toxicity._weight(found, folded), len(folded) - 2) * lexicon.slope + lexicon.intercept
        return 1 / (1 + 2.718281828459045 ** -z)

    clean = materialize(stages["toxicity"](spark, docs, SF), "clean")
    assert clean.columns == docs.columns and texts(clean) == {k: t for k, t in before.items() if score(t) < 0.5}
    single = materialize(stages["near_duplicates"](spark, clean, SF), "single")
    component = brute(sorted(texts(clean).items()))
    assert single.columns == docs.columns and set(texts(single)) == {k for k, (n, least) in component.items() if not n or k == least}

    # Every shared run of eight words is a leak; what else the stage drops shares the template of an item.
    items = [re.findall(r"\w+", r.text.lower()) for r in queries.table(spark, SF, "benchmark").collect()]
    grams = {tuple(words[k : k + 8]) for words in items for k in range(len(words) - 7)}
    own = materialize(stages["decontamination"](spark, single, SF), "own")
    leaks = set()
    for k, text in texts(single).items():
        words = re.findall(r"\w+", (text or "").lower())
        if sum(tuple(words[i : i + 8]) in grams for i in range(len(words) - 7)) >= 2:
            leaks.add(k)
    kept = set(texts(own))
    assert not kept & leaks and len(set(texts(single)) - kept - leaks) <= 0.02 * len(before)

    private = materialize(stages["personal_data"](spark, own, SF), "private")
    new, old = {r.doc_id: r for r in private.collect()}, texts(own)
    assert private.columns == docs.columns and set(new) == kept
    assert all(r.n_chars == len(r.text or "") for r in new.values())
    mail = re.compile(r"[\w.+-]+@[\w-]+\.\w+")
    assert all(not set(mail.findall(old[k])) & set(mail.findall(r.text)) for k, r in new.items())

    pieces = stages["packing"](spark, private, SF).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    places = defaultdict(list)
    for r in pieces:
        ids = [*plain.encode(new[r.doc_id].text, add_special_tokens=False).ids, 0]
        own_ids = ids[r.start : r.start + r.length]
        assert len(own_ids) == r.length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own_ids)) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in pieces} == kept
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_stages_with_odd_rows(spark):
    docs = queries.table(spark, SF, "documents")
    long = "word " * 60_000 + "mail ann@c.example"
    rows = [(None, "some null id text"), (None, None), (7001, None), (7002, ""), (7003, " \n"), (7004, long), (7005, "twice the same row here"),
            (7005, "twice the same row here"), (7006, "an unlike text"), (7006, "under one number")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")})
    clash = {"_row": F.lit("r"), "_found": F.lit(1), "component": F.lit(2.5), "kept": F.lit(True), "_key": F.array(F.lit("k")), "task": F.lit("t"), "n": F.lit(None).cast("int")}
    for table in (odd, odd.limit(0)):
        frame = table.withColumns(clash)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, frame, SF), name)
            assert out.columns == frame.columns and dict(out.dtypes) == dict(frame.dtypes)
            assert out.filter("_row = 'r' and component = 2.5 and kept").count() == out.count()
            left = Counter((r.doc_id, r.text) for r in out.collect())
            if table is odd:
                expected = Counter(rows)
                if name in ("near_duplicates", "decontamination", "personal_data"):
                    expected[7005, "twice the same row here"] = 1
                if name == "personal_data":
                    assert left[7004, long] == 0
                    del expected[7004, long]
                    left = Counter({k: n for k, n in left.items() if k[0] != 7004})
                assert left == expected
            frame = out
        packed = dict(corpus_pipeline.STAGES)["packing"](spark, frame, SF).collect()
        assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in frame.collect())
