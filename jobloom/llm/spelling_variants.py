"""Spelling variants of a vocabulary: words one edit apart, found by K-d trees over letter counts.

A word is the vector of its letter counts. One replaced letter takes one count down and another up, and one inserted
letter takes one count up, so near words lie at an L1 distance of at most two. The words of a length are dealt
into regions, the leaves of a K-d tree whose upper splits come from a bounded sample of words: a word lives in one
region, and asks in each region whose box it can reach by one edit, for its own length and for the next. Each
region is searched by a K-d tree of its own with tight boxes, down to a few words whose letter order is compared.
The sample only balances the regions; every word is indexed and every near pair is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.scratch import discard, materialize

#: About as many words live in a region.
REGION_WORDS = 12_000
#: About as many words are sampled to place the splits; no leaf holds fewer than ``LEAST_SAMPLE`` of them.
SAMPLE_WORDS, LEAST_SAMPLE = 200_000, 16
#: A region's own tree ends at as many words.
LEAF_WORDS = 12
#: Letters are counted by code point modulo this; letters that fall together only make boxes wider.
LETTERS = 191
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOME, _ASKS = 1, 2


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, drop_one_in: int = 97) -> DataFrame:
    """``word, n``: runs of letters of whole texts, A-Z lower-cased, some of them misspelt on purpose.

    With h the crc32 of ``<doc_id>:<run>``, a run with ``drop_one_in`` dividing h loses its letter ``h % length``.
    Words have at least ``least_length`` letters and occur ``least_count`` times. Null and empty texts hold none, a
    null doc_id counts as an empty one, repeated rows count each time, and no other column is read.
    """
    lowered = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    # Shorter runs can't give a word: what is misspelt only loses letters.
    runs = F.regexp_extract_all(lowered, F.lit(rf"([a-zÀ-ÿ]{{{least_length},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % drop_one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def letters(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    codes = np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(-1, length) if words else np.zeros((0, length), np.uint32)
    return codes.astype(np.uint8) if codes.size and codes.max() < 256 else codes


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """``(words, LETTERS)``: how often each letter stands in each word."""
    n, length = codes.shape
    places = np.arange(n)[:, None] * LETTERS + codes % LETTERS if length else np.zeros((n, 0), np.int64)
    return np.bincount(places.ravel(), minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


def _split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and the count that part the words most evenly (left: up to that count), or None if none does."""
    n, low, high = len(counts), counts.min(axis=0), counts.max(axis=0)
    best = None
    varied = np.flatnonzero(low < high)
    own = counts[:, varied]
    for at in range(int(low[varied].min(initial=0)), min(int(high[varied].max(initial=0)), int(low[varied].min(initial=0)) + 64)):
        left = (own <= at).sum(axis=0)
        uneven = np.where((left > 0) & (left < n), np.abs(2 * left - n), n + 1)
        k = int(uneven.argmin()) if len(uneven) else 0
        if len(uneven) and uneven[k] <= n and (best is None or uneven[k] < best[0]):
            best = (int(uneven[k]), int(varied[k]), at)
    if best is None and len(varied):  # all counts lie far above the least one
        letter = int(varied[0])
        return letter, int(low[letter])
    return best and best[1:]


def _over(low: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum(low - x, 0)


class Regions:
    """The upper splits of one length's K-d tree; ``parts`` of a leaf share its words if no split makes it smaller."""

    def __init__(self, sample: np.ndarray, words: int):
        self.nodes: list[tuple[int, int, int, int] | None] = []  # letter, count, left, right; None: a leaf
        self.parts: dict[int, int] = {}
        self._grow(sample, words / len(sample)) if len(sample) else self._grow(np.zeros((1, LETTERS), int), words)

    def _grow(self, sample: np.ndarray, each: float) -> None:
        todo = [(0, sample)]
        self.nodes.append(None)
        while todo:
            node, own = todo.pop()
            split = _split(own) if len(own) * each > REGION_WORDS and len(own) >= 2 * LEAST_SAMPLE else None
            if split is None:
                self.parts[node] = max(1, int(np.ceil(len(own) * each / (4 * REGION_WORDS))))
                continue
            left = own[:, split[0]] <= split[1]
            self.nodes[node] = (*split, len(self.nodes), len(self.nodes) + 1)
            todo += [(len(self.nodes), own[left]), (len(self.nodes) + 1, own[~left])]
            self.nodes += [None, None]

    def reached(self, counts: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, the words that reach it) by up to ``more`` letters gained and ``fewer`` lost; by 0 and 0 each word's own leaf."""
        wide = np.full(LETTERS, 1 << 30)
        todo = [(0, np.arange(len(counts)), np.zeros(len(counts), int), np.zeros(len(counts), int), -wide, wide)]
        while todo:
            node, at, gained, lost, low, high = todo.pop()
            if not len(at):
                continue
            if self.nodes[node] is None:
                yield node, at
                continue
            letter, most, left, right = self.nodes[node]
            x = counts[at, letter]
            if most < high[letter]:
                down = lost + _over(x, most) - _over(x, high[letter])
                ok = down <= fewer
                tighter = high.copy()
                tighter[letter] = most
                todo.append((left, at[ok], gained[ok], down[ok], low, tighter))
            up = gained + _over(most + 1, x) - _over(low[letter], x)
            ok = up <= more
            tighter = low.copy()
            tighter[letter] = max(low[letter], most + 1)
            todo.append((right, at[ok], up[ok], lost[ok], tighter, high))


def plan_regions(words: DataFrame) -> dict[int, Regions]:
    """The splits of each length with over ``REGION_WORDS`` words; other lengths are one region each."""
    sizes = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"))
    many = {r["length"]: r["n"] for r in sizes.filter(F.col("n") > REGION_WORDS).collect()}
    if not many:
        return {}
    share = min(1.0, SAMPLE_WORDS / sum(many.values()))
    drawn = F.pmod(F.xxhash64("word", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    sample: dict[int, list[str]] = {length: [] for length in many}
    for r in words.filter(drawn & F.length("word").isin(*many)).select("word").collect():  # about SAMPLE_WORDS
        sample[len(r["word"])].append(r["word"])
    return {length: Regions(letter_counts(letters(found, length)), many[length]) for length, found in sample.items()}


def _route(plan: dict[int, Regions]):
    """``(length, leaf, part, role, word, n)``: where a word lives (and asks), and where it asks only."""

    def rows(table: pa.Table, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
        lengths, dealt = np.array([len(w) for w in words]), table.column("dealt").to_numpy()
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            counts = letter_counts(letters([words[k] for k in at], length)) if {length, length + 1} & plan.keys() else None
            own = np.full(len(at), -1)
            for leaf, k in plan[length].reached(counts, 0, 0) if length in plan else [(0, np.arange(len(at)))]:
                parts = plan[length].parts[leaf] if length in plan else 1
                own[k] = leaf
                for part in range(parts):
                    mine = dealt[at[k]] % parts == part
                    yield length, leaf, at[k], np.where(mine, _HOME | _ASKS, _ASKS), part
            for leaf, k in plan[length].reached(counts, 1, 1) if length in plan else []:
                k = k[own[k] != leaf]
                for part in range(plan[length].parts[leaf]):
                    yield length, leaf, at[k], np.full(len(k), _ASKS), part
            for leaf, k in plan[length + 1].reached(counts, 1, 0) if length + 1 in plan else [(0, np.arange(len(at)))]:
                for part in range(plan[length + 1].parts[leaf] if length + 1 in plan else 1):
                    yield length + 1, leaf, at[k], np.full(len(k), _ASKS), part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for length, leaf, at, role, part in rows(table, batch.column(0).to_pylist()):
                fixed = [pa.array(np.full(len(at), x, np.int32)) for x in (length, leaf, part)]
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*fixed, pa.array(role.astype(np.int32)), own.column(0), own.column(1)],
                    names=["length", "leaf", "part", "role", "word", "n"],
                )

    return run


def near_pairs(home: list[str], same: list[str], shorter: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(place in same + shorter, place in home)`` of all words one edit apart; ``shorter`` have one letter less than ``home``."""
    if not home or not (same or shorter):
        return np.zeros(0, int), np.zeros(0, int)
    length = len(home[0])
    codes, own, less = letters(home, length), letters(same, length), letters(shorter, length - 1)
    points = letter_counts(codes)
    asked = np.concatenate((letter_counts(own), letter_counts(less)))
    used = np.flatnonzero(points.any(axis=0) | asked.any(axis=0))
    points, asked = points[:, used], asked[:, used]
    may_lose = np.concatenate((np.ones(len(same), int), np.zeros(len(shorter), int)))
    wide = np.full(len(used), 1 << 30)
    todo = [(np.arange(len(points)), np.arange(len(asked)), np.zeros(len(asked), int), np.zeros(len(asked), int), -wide, wide)]
    asking, found = [], []
    while todo:
        at, q, gained, lost, low, high = todo.pop()
        box = points[at]
        tight_low, tight_high = box.min(axis=0), box.max(axis=0)
        for letter in np.flatnonzero((tight_low > low) | (tight_high < high)):
            x = asked[q, letter]
            gained = gained + _over(tight_low[letter], x) - _over(low[letter], x)
            lost = lost + _over(x, tight_high[letter]) - _over(x, high[letter])
            ok = (gained <= 1) & (lost <= may_lose[q])
            q, gained, lost = q[ok], gained[ok], lost[ok]
            if not len(q):
                break
        if not len(q):
            continue
        split = _split(box) if len(at) > LEAF_WORDS else None
        if split is None:
            for a, b in _in_order(codes, own, less, at, q):
                asking.append(a)
                found.append(b)
            continue
        left = box[:, split[0]] <= split[1]
        todo += [(at[left], q, gained, lost, tight_low, tight_high), (at[~left], q, gained, lost, tight_low, tight_high)]
    return (np.concatenate(asking), np.concatenate(found)) if asking else (np.zeros(0, int), np.zeros(0, int))


def _in_order(codes: np.ndarray, own: np.ndarray, less: np.ndarray, at: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``q`` and ``at`` that one edit parts, compared letter by letter in blocks of about 4 MB."""
    step = max(1, (4 << 20) // max(1, len(at) * codes.shape[1]))
    for k in range(0, len(q), step):
        part = q[k : k + step]
        same, shorter = part[part < len(own)], part[part >= len(own)]
        if len(same):
            i, j = np.nonzero((own[same][:, None, :] != codes[at][None, :, :]).sum(axis=2) == 1)
            yield same[i], at[j]
        if len(shorter):
            a, b = less[shorter - len(own)][:, None, :], codes[at][None, :, :]
            before = np.logical_and.accumulate(a == b[:, :, :-1], axis=2).sum(axis=2)
            after = np.logical_and.accumulate((a == b[:, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
            i, j = np.nonzero(before + after >= a.shape[2])
            yield shorter[i], at[j]


def _best(of: np.ndarray, to: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct ``of``: how many ``to``, and the one of largest n and then least rank."""
    order = np.lexsort((rank, -n, of))
    first = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))[: len(order)]
    return of[order][first], np.diff(np.append(first, len(order))), to[order][first]


def _search(table: pa.Table) -> pa.Table:
    """What a region adds to each word: its near words, and the most frequent of them."""
    length = table.column("length")[0].as_py()
    words, n, role = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("role").to_numpy()
    size = np.array([len(w) for w in words])
    home, same, shorter = (np.flatnonzero(x) for x in ((role & _HOME) > 0, size == length, size == length - 1))
    a, b = near_pairs([words[k] for k in home], [words[k] for k in same], [words[k] for k in shorter])
    rank = np.empty(len(words), int)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    asks, found = np.concatenate((same, shorter))[a], home[b]
    back = size[asks] < length  # a longer word never asks among shorter ones: it is told
    of, to = np.concatenate((asks, found[back])), np.concatenate((found, asks[back]))
    of, near, to = _best(of, to, n[to], rank[to])
    text = table.column("word").combine_chunks()
    return pa.table({
        "word": text.take(pa.array(of)), "near": pa.array(near.astype(np.int64)), "form": text.take(pa.array(to)), "form_n": pa.array(n[to]),
    })


def nearest_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n`` of a table ``word, n`` of distinct words that gives the same rows when read again."""
    dealt = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("dealt"))
    routed = dealt.mapInArrow(_route(plan_regions(words)), "length int, leaf int, part int, role int, word string, n long")
    told = routed.groupBy("length", "leaf", "part").applyInArrow(_search, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form"))).alias("best")
    told = told.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    rows = words.join(told, "word", "left")
    holds = -F.col("best.minus") >= ratio * F.col("n")
    return rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(holds, F.col("best.form")).alias("form"), F.when(holds, -F.col("best.minus")).alias("form_n"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds ``root``: the last word that is reached by following ``form``, or the word itself.

    Counts grow along a chain, so it has no cycle; each round follows twice as many forms as the one before.
    """
    links = materialize(forms.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(further, "root", "left")
        following = materialize(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        ended = following.filter("moved").isEmpty()
        discard(links)
        links = following
        if ended:
            return forms.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Groups a vocabulary ``word, n`` by spelling: ``word, form, root, n, n_near, form_n``.

    Two words are near if one inserted, deleted or replaced letter (code point) parts them. ``form`` is a word's near
    word of largest n, of equal ones the least in code-point order, if that n is at least ``ratio`` times the word's own;
    ``root`` is where following forms ends. Null and empty words and those with n below 1 are left out, repeated words
    are added up (a null n counts as 0), words of any length and any script are compared whole, an empty table gives no rows, and other
    columns are never read.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that counts grow along a chain of forms")
    known = words.select(F.col("word").cast("string"), F.col("n").cast("long")).filter("word is not null and word <> ''")
    known = materialize(known.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "words")
    forms = materialize(nearest_forms(known, ratio), "nearest")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
