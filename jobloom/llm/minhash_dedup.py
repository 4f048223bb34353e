"""MinHash near-duplicate detection by a multi-index Hamming join.

A document's set is its distinct ``shingle_size``-word shingles. Of each of 32 MinHash values 16 bits are
kept, and the signature distance of two sets is the number of values whose bits differ. The signature is
split into eight chunks of four values: by the pigeonhole principle two signatures at a distance of up to 15
agree in some chunk but for at most one value, so every chunk is indexed four times with one value left out
and a hash join on those keys meets every such pair. At a Jaccard similarity of 0.75 a pair shares no key
with a probability of about 2e-5. Nothing else cuts candidates but their set sizes, which must allow the
similarity; they are confirmed on the full sets. Keys hold 48 bits of signature, so that unlike documents
rarely meet however many there are.

Documents with equal sets form one class, named by a 64-bit hash of the set, and only classes are compared.
Within a key, classes are first linked to two centres (linear in the bucket), components are formed, and
only classes of one key that are still in different components are then compared with each other: pair by
pair in small keys, and in blocks inside the tasks in large ones. A large group of copies never expands
into rows for all its pairs, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm import textvec
from jobloom.llm.numbering import join_hint
from jobloom.llm.scratch import discard, fresh, materialize
from jobloom.operators.components import connected_components

VALUES, CHUNK = 32, 4  # MinHash values of 16 bits; values of a chunk, packed into one long
#: Keys with up to this many classes are compared pair by pair, larger ones in blocks of BLOCK classes.
SMALL_KEY, BLOCK = 24, 256

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = np.uint64(0xD6E8FEB86659FD93)


_PACKED = [f"s{k}" for k in range(VALUES // CHUNK)]


def _set_keys(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set of shingles, in two parts."""
    one = textvec.mix(np.add.reduceat(values, begin))
    return one, textvec.mix(np.add.reduceat(textvec.mix(values ^ _KEY), begin))


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, w in textvec.words(batch.column(1)):
                values, at = textvec.distinct(*textvec.shingles(w, size))
                n = np.diff(at)
                some = np.flatnonzero(n)
                signature = np.zeros((len(n), VALUES), dtype=np.uint16)
                keys = np.zeros((2, len(n)), dtype=np.uint64)
                if len(some):
                    begin = at[:-1][some]
                    for k in range(VALUES):
                        least = np.minimum.reduceat((values ^ _XOR[k]) * _MUL[k], begin)
                        signature[some, k] = textvec.mix(least) >> np.uint64(48)
                    keys[:, some] = _set_keys(values, begin)
                packed = np.ascontiguousarray(signature).view(np.int64)
                ids = batch.column(0).slice(first, len(n))
                arrays = [ids, pa.array(n), *map(pa.array, keys.view(np.int64)), *map(pa.array, packed.T.copy())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "k1", "k2", *_PACKED])

    return run


def signatures(docs: DataFrame, shingle_size: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, k1, k2, s0..s7)``: set size, a 128-bit key of the set, the packed signature."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _features(shingle_size), ", ".join(f"{name} long" for name in ("doc_id", "n_shingles", "k1", "k2", *_PACKED))
    )


def _set_key(size: int):
    """The first part of the key of a text's set; null without words."""

    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype="Int64")
        for first, w in textvec.words(pa.array(texts, pa.string())):
            values, at = textvec.distinct(*textvec.shingles(w, size))
            some = np.flatnonzero(np.diff(at))
            if len(some):
                out[first + some] = _set_keys(values, at[:-1][some])[0].view(np.int64)
        return out

    return key


def _index_keys() -> Column:
    """The 32 index keys of a signature: a chunk with one of its four values left out."""
    keys = []
    for chunk, name in enumerate(_PACKED):
        for left_out in range(CHUNK):
            below = F.col(name).bitwiseAND(F.lit((1 << 16 * left_out) - 1))
            above = F.shiftrightunsigned(name, 16 * (left_out + 1)) if left_out < CHUNK - 1 else F.lit(0).cast("long")
            kept = below.bitwiseOR(F.shiftleft(above, 16 * left_out))
            keys.append(kept.bitwiseOR(F.lit((chunk * CHUNK + left_out) << 48)))
    return F.array(*keys)


def _sets(column: pa.Array | pa.ChunkedArray, size: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, w in textvec.words(column):
        values, at = textvec.distinct(*textvec.shingles(w, size))
        out += [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):  # bounds the sets held at once
                part = batch.slice(first, 256)
                encoded = part.column(2).dictionary_encode()  # a centre's text repeats
                centre, other = _sets(encoded.dictionary, size), _sets(part.column(3), size)
                kept = []
                for code, y in zip(encoded.indices.to_pylist(), other, strict=True):
                    x = centre[code]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    kept.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


class _Corpus(NamedTuple):
    """Documents with their features and classes: ``classes(cid, rep, n_shingles, s0..s7)``."""

    docs: DataFrame
    feats: DataFrame
    classes: DataFrame
    repeats: bool  #: whether any doc_id stands in several rows
    size: int
    percent: int

    def texts(self, ids: DataFrame) -> DataFrame:
        """``(cid, text)``, one row for each class of ``ids(cid)``."""
        wanted = ids.join(self.classes.select("cid", "rep"), "cid")
        found = self.docs.join(wanted.hint(join_hint(ids.count())), F.col("doc_id") == F.col("rep")).select("cid", "text")
        if self.repeats:  # a doc_id may then hold other texts as well
            found = found.filter(_set_key(self.size)("text") == F.col("cid")).dropDuplicates(["cid"])
        return materialize(found, "texts")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs(a, b)`` of classes whose full sets are similar enough."""
        pairs = materialize(pairs, "pairs")
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ids")
        texts = self.texts(ids)
        right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
        left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
        joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
        links = materialize(joined.mapInArrow(_confirm(self.size, self.percent), "a long, b long").distinct(), "links")
        discard(pairs, ids, texts)
        return links


def _block(size: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        comp = table.column("comp").to_numpy()
        lower = table.column("lower").to_numpy(zero_copy_only=False)
        found: set[tuple[int, int]] = set()
        runs = _sets(table.column("text"), size)
        n = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        owner = np.repeat(np.arange(len(runs)), n)
        _, code, seen = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
        again = seen[code] > 1  # a shingle of one text alone is in no intersection
        _, column = np.unique(code[again], return_inverse=True)
        same = bool((side == side[0]).all())
        left = np.arange(len(runs)) if same else np.flatnonzero(side == side.min())
        right = left if same else np.flatnonzero(side != side.min())
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        place = np.full((2, len(runs)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        at, width = owner[again], 4096
        for first in range(0, int(column.max(initial=-1)) + 1, width):
            part = (column >= first) & (column < first + width)
            ones = []
            for k, rows in enumerate((left, right)):
                mine = part & (place[k, at] >= 0)
                m = np.zeros((len(rows), width), dtype=np.float32)
                m[place[k, at[mine]], column[mine] - first] = 1
                ones.append(m)
            both += ones[0] @ ones[1].T
        apart = (comp[left][:, None] != comp[right][None, :]) & ~(lower[left][:, None] & lower[right][None, :])
        enough = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        for i, j in zip(*np.nonzero(apart & enough & (both > 0)), strict=True):
            x, y = int(comp[left[i]]), int(comp[right[j]])
            found.add((min(x, y), max(x, y)))
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _block_links(large: DataFrame, corpus: _Corpus) -> DataFrame | None:
    """Links between components whose classes share large keys, as pairs of component ids.

    Keys with members in common form one family, so that a pair is met once and not once a key. A family
    is dealt by set size into bands of the ratio that the threshold allows, and a band into blocks of about
    ``BLOCK`` members: a component that fills blocks has blocks of its own, which are never compared with each
    other, and the others share blocks. A task counts the shared shingles of two blocks and returns at most
    one link for two components. No pair becomes a row, and blocks of one large family spread over many tasks.
    """
    if large.isEmpty():
        return None
    centre = materialize(large.groupBy("key").agg(F.min("cid").alias("centre")), "centre")
    family = connected_components(large.join(centre, "key").selectExpr("centre as a", "cid as b"))
    members = large.select("cid", "comp", "n_shingles").distinct().join(family, F.col("cid") == F.col("node"))
    band = F.floor(F.log("n_shingles") / -np.log(corpus.percent / 100)).cast("int")
    members = members.select("cid", "comp", F.col("component").alias("family"), band.alias("own"))
    members = materialize(members.withColumn("band", F.explode(F.array("own", F.col("own") + 1))), "members")
    sizes = members.groupBy("family", "band", "comp").agg(F.count("*").alias("n"), F.max("own").alias("top"))
    bands = sizes.groupBy("family", "band").agg(
        F.min("comp").alias("p"), F.max("comp").alias("q"), F.max("top").alias("top"),
        F.sum(F.when(F.col("n") <= BLOCK, F.col("n"))).alias("others"),
    )
    bands = bands.filter("p < q and top = band").select("family", "band", F.ceil(F.col("others") / BLOCK).cast("int").alias("shared"))
    own = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK).cast("int"))
    sizes = materialize(sizes.join(bands, ["family", "band"]).select("family", "band", "comp", own.alias("blocks"), "shared"), "sizes")
    blocks = sizes.select(
        "family", "band", F.when(F.col("blocks").isNotNull(), F.col("comp")).alias("owner"),
        F.explode(F.sequence(F.lit(0), F.coalesce("blocks", "shared") - 1)).alias("nth"),
    ).distinct()
    blocks = blocks.select("family", "band", F.struct("owner", "nth").alias("block"))
    x, y = blocks.withColumnRenamed("block", "i"), blocks.withColumnRenamed("block", "j")
    meeting = x.join(y, ["family", "band"]).filter(
        (F.col("i") <= F.col("j")) & ~F.coalesce(F.col("i.owner") == F.col("j.owner"), F.lit(False))
    )
    sides = F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))
    sides = F.when(F.col("i") == F.col("j"), F.slice(sides, 1, 1)).otherwise(sides)
    meeting = meeting.select("family", "band", "i", "j", F.explode(sides).alias("of")).select("family", "band", "i", "j", "of.*")
    nth = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", "shared")).cast("int").alias("nth")
    dealt = members.join(sizes, ["family", "band", "comp"]).select(
        "cid", "comp", "family", "band", (F.col("own") < F.col("band")).alias("lower"),
        F.struct(F.when(F.col("blocks").isNotNull(), F.col("comp")).alias("owner"), nth).alias("block"),
    )
    # Few rows of sizes may make very many of meeting blocks, which the planner cannot tell: nothing of it is broadcast.
    dealt = materialize(dealt.join(meeting.hint("merge"), ["family", "band", "block"]).drop("block"), "dealt")
    texts = corpus.texts(dealt.select("cid").distinct())
    found = dealt.hint("merge").join(texts, "cid").groupBy("family", "band", "i", "j")
    links = materialize(found.applyInArrow(_block(corpus.size, corpus.percent), "a long, b long").distinct(), "block-links")
    discard(members, sizes, dealt, texts)
    return links


def _linked(docs: DataFrame, shingle_size: int, percent: int) -> tuple[_Corpus, DataFrame]:
    """The corpus, and ``(k1, k2, rep, component, least)``: of each set its smallest doc_id and that of its component."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    feats = materialize(signatures(docs, shingle_size), "signatures")
    classes = (
        feats.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ["n_shingles", *_PACKED]))
    )
    classes = materialize(classes.withColumn("cid", F.col("k1")), "classes")
    repeats = not feats.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").isEmpty()
    corpus = _Corpus(docs, feats, classes, repeats, shingle_size, percent)
    entries = classes.select("cid", F.explode(_index_keys()).alias("key"))
    # What is counted by key is written first: a hot key is then a skewed partition of the join, which Spark can split.
    ends = entries.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi")
    ends = materialize(ends, "ends")
    shared = materialize(entries.join(ends, "key"), "shared")

    sides = classes.select("cid", "n_shingles")
    alike = F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * percent

    def plausible(pairs: DataFrame) -> DataFrame:
        x, y = sides.alias("x"), sides.alias("y")
        near = pairs.join(x, F.col("a") == F.col("x.cid")).join(y, F.col("b") == F.col("y.cid"))
        return near.filter(alike).select("a", "b")

    stars = shared.select(F.explode(F.array("lo", "hi")).alias("c"), "cid").filter("c <> cid")
    stars = stars.select(F.least("c", "cid").alias("a"), F.greatest("c", "cid").alias("b")).distinct()
    links = corpus.links(plausible(stars))
    components = connected_components(links)

    # What shares a key but no component yet: in small keys pair by pair ...
    placed = shared.select("key", "cid").join(components, shared.cid == components.node, "left")
    placed = materialize(placed.select("key", "cid", F.coalesce("component", "cid").alias("comp")), "placed")
    open_keys = placed.groupBy("key").agg(
        F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("members")
    )
    open_keys = materialize(open_keys.filter("p < q").select("key", "members"), "open-keys")
    rest = materialize(placed.join(open_keys, "key").join(sides, "cid"), "rest")
    small = rest.filter(F.col("members") <= SMALL_KEY)
    met = small.alias("x").join(
        small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & alike
    )
    met = met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    more = corpus.links(met)
    # ... and in large keys block by block.
    large = rest.filter(F.col("members") > SMALL_KEY).select("key", "cid", "comp", "n_shingles")
    blocks = _block_links(large, corpus)
    more = more if blocks is None else more.unionByName(blocks)
    if not more.isEmpty():
        # Links between components, so that settled groups are not joined again.
        merged = connected_components(_between(more, components))
        roots = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
        grown = components.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        alone = merged.join(components.select("node"), "node", "left_anti").select("node", "component")
        components = grown.unionByName(alone)
    found = classes.select("k1", "k2", "cid", "rep").join(components, F.col("cid") == F.col("node"), "left")
    found = materialize(found.select("k1", "k2", "rep", F.coalesce("component", "cid").alias("component")), "found")
    least = materialize(found.groupBy("component").agg(F.min("rep").alias("least")), "least")
    discard(ends, shared, placed, open_keys, rest)
    return corpus, found.join(least, "component")


def _between(links: DataFrame, components: DataFrame) -> DataFrame:
    """``links(a, b)`` with their ends replaced by their components."""
    for end in ("a", "b"):
        named = components.select(F.col("node").alias(end), F.col("component").alias("of"))
        other = "b" if end == "a" else "a"
        links = links.join(named, end, "left").select(F.coalesce("of", end).alias(end), other)
    return links


def minhash_components(docs: DataFrame, shingle_size: int = 5, percent: int = 75) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text, ...)``.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept, class_id``. ``component_id`` is
    the smallest doc_id reachable over links, ``class_id`` the smallest doc_id with the same set, ``kept``
    marks the document that stays. Null or wordless texts have no shingles and link with nothing. A
    repeated doc_id gives one row per repetition, each in the component of its text; a null doc_id links
    with nothing and is kept. Texts of any length are used whole. Other columns are ignored.
    """
    corpus, found = _linked(docs, shingle_size, percent)
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (
        corpus.feats.select("doc_id", "n_shingles", "k1", "k2")
        .join(found, ["k1", "k2"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(linked, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(linked, F.col("least") == F.col("doc_id")).otherwise(F.lit(True)).alias("kept"),
            F.when(linked, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"),
        )
    )


def drop_near_duplicates(docs: DataFrame, shingle_size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each near-duplicate component; columns and other rows are unchanged.

    Rows without words and rows with a null doc_id link with nothing and all stay. Where a doc_id stands in
    several rows, each counts by its own text: unlike texts stay, and of rows in one component one stays.
    """
    corpus, found = _linked(docs, shingle_size, percent)
    rows = corpus.feats.select("doc_id", "n_shingles", "k1", "k2").filter("doc_id is not null").join(found, ["k1", "k2"], "left")
    gone = rows.filter("n_shingles > 0 and doc_id <> least").select(F.col("doc_id").alias("_gone")).distinct()
    out = fresh(docs.columns, "_gone")
    gone = materialize(gone.withColumnRenamed("_gone", out), "gone")
    same = F.col("doc_id").cast("long") == F.col(out)
    if not corpus.repeats:
        return docs.join(gone.hint(join_hint(gone.count())), same, "left_anti")
    key, of, first, nth = (fresh(docs.columns, c) for c in ("_key", "_of", "_least", "_nth"))
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(out))
    again = materialize(again, "again")
    once = docs.join(gone.unionByName(again), same, "left_anti")
    mine = docs.join(again, same, "left_semi").withColumn(key, _set_key(shingle_size)(F.col("text").cast("string")))
    # Of the rows of a component that carry its smallest doc_id, all of them may repeat it: one stays.
    named = found.select(F.col("k1").alias(key), F.col("component").alias(of), F.col("least").alias(first))
    mine = mine.join(named, key, "left")
    order = Window.partitionBy(of).orderBy(*[c for c, t in docs.dtypes if not t.startswith("map")])
    linked = mine.filter(F.col(of).isNotNull() & (F.col("doc_id").cast("long") == F.col(first)))
    linked = linked.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    stay = mine.filter(F.col(of).isNull()).select(docs.columns).unionByName(linked.select(docs.columns))
    return once.unionByName(stay)
