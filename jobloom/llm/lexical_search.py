"""Ranked lexical search over a K2-treap of the term-document grid.

The index cuts the documents into blocks. A block's grid has a row for each term and a column for each document, and a
cell holds the impact of the term in the document. The grid becomes a K2-treap: a quadtree whose nodes hold the largest
impact below them and where it stands; that cell is taken out, and empty quadrants have no node, so that there is one
node a cell. Nodes stand level by level; a node has four bits for its quadrants, from which its children's places follow by
counting, and its impact as what it lacks to its parent's.

A search follows the rows of all its terms at once, from the whole block down to ranges of documents. A range is bounded by
the sum over terms of weight times the largest impact that the row may still have in it; ranges are taken best first,
some hundred at a time, and those bounded below the k-th best score are dropped. The best of all blocks are then ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm import textvec
from jobloom.llm.scratch import materialize

#: A block ends with as many documents or terms; one document is never parted.
BLOCK_DOCS, BLOCK_TERMS = 1 << 14, 2_000_000
#: Items are searched together up to about as many bytes of text.
ITEM_BYTES = 4 << 20
#: Ranges that are taken at once.
WAVE = 192
INDEX = (
    "docs array<long>, terms binary, df binary, bits int, children binary, lacks binary, row binary, col binary"
)

_BITS_SET = np.array([bin(k).count("1") for k in range(16)], dtype=np.int64)


@dataclass
class Corpus:
    """What all blocks share: documents with a term, and all their terms with repeats."""

    documents: int
    terms: int

    def impacts(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * length * self.documents) // max(1, self.terms)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of ``x``, up to 31, with a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class K2Treap:
    """Arrays over nodes, level by level: quadrants in use, what the impact lacks to the parent's, and where in its cell it stands."""

    def __init__(self, bits: int, children: np.ndarray, lacks: np.ndarray, row: np.ndarray, col: np.ndarray):
        self.bits, self.children, self.lacks, self.row, self.col = bits, children, lacks, row, col
        self.first = 1 + np.cumsum(_BITS_SET[children]) - _BITS_SET[children]  # the first child of each node

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, impact: np.ndarray) -> K2Treap:
        """A treap of distinct cells with positive impacts."""
        bits = int(max(row.max(initial=0), col.max(initial=0))).bit_length()
        cell = (_spread(row) << np.uint64(1)) | _spread(col)
        order = np.argsort(cell)
        cell, row, col, impact = cell[order], row[order], col[order], impact[order]
        levels, above, above_at = [], None, None
        for level in range(bits + 1):
            if not len(cell):
                break
            node = cell >> np.uint64(2 * (bits - level))
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            largest = np.maximum.reduceat(impact, starts)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cell))))
            at = np.flatnonzero(impact == largest[of])
            at = at[np.concatenate(([True], of[at][1:] != of[at][:-1]))]  # of equal ones the first cell
            node = node[starts]
            if level:  # each child marks its quadrant
                parent = np.searchsorted(above_at, node >> np.uint64(2))
                levels[-1][0][:] = np.bincount(parent, 1 << (node & np.uint64(3)).astype(np.int64), len(above_at)).astype(np.uint8)
                lacks = above[parent] - largest
            else:
                lacks = (1 << 30) - largest
            within = (1 << (bits - level)) - 1
            levels.append((np.zeros(len(node), np.uint8), lacks, row[at] & within, col[at] & within))
            above, above_at = largest, node
            rest = np.ones(len(cell), bool)
            rest[at] = False
            cell, row, col, impact = cell[rest], row[rest], col[rest], impact[rest]
        parts = [np.concatenate([x[k] for x in levels]) if levels else np.zeros(0, np.int64) for k in range(4)]
        return cls(bits, parts[0].astype(np.uint8), parts[1].astype("<u4"), parts[2].astype("<u4"), parts[3].astype("<u2" if bits <= 16 else "<u4"))

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of at least ``least``, with all that the k best can be, equal ones included.

        A column's score is the sum over ``rows`` of weight times impact.
        """
        cols, scores, bar = [], [], max(1, least)
        if not len(self.children) or not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_terms = len(rows)
        terms, root = np.arange(n_terms), np.zeros(n_terms, np.int64)
        # A range has a level and a place; live nodes (term, node, impact) and cells met so far (term, column, impact).
        level, place, bound = np.zeros(1, int), np.zeros(1, int), np.full(1, np.iinfo(np.int64).max)
        top = (1 << 30) - int(self.lacks[0])
        live = (np.array([0, n_terms]), terms, root, np.full(n_terms, top))
        hit = np.flatnonzero(rows == self.row[0])
        met = (np.array([0, len(hit)]), hit, np.full(len(hit), int(self.col[0])), np.full(len(hit), top))
        pools = [(level, place, bound, live, met)]
        while pools:
            level, place, bound, live, met = pools.pop()
            chosen = np.flatnonzero(bound >= bar)
            if len(chosen) > WAVE:
                chosen = chosen[np.argpartition(-bound[chosen], WAVE - 1)]
                pools.append(_part(level, place, bound, live, met, chosen[WAVE:]))
                chosen = chosen[:WAVE]
            if not len(chosen):
                continue
            level, place, bound, live, met = _part(level, place, bound, live, met, chosen)
            shift = np.maximum(self.bits - 1 - level, 0)
            of, term, node, impact = np.repeat(np.arange(len(level)), np.diff(live[0])), *live[1:]
            used = self.children[node].astype(np.int64)
            below = []
            for half in (0, 1):
                quadrant = 2 * ((rows[term] >> shift[of]) & 1) + half
                has = (used >> quadrant) & 1 == 1
                child = self.first[node[has]] + _BITS_SET[used[has] & ((1 << quadrant[has]) - 1)]
                below.append((2 * of[has] + half, term[has], child, impact[has]))
            key, term, node, impact = (np.concatenate(x) for x in zip(*below, strict=True))
            impact = impact - self.lacks[node]
            depth = shift[key >> 1]
            hit = self.row[node] == (rows[term] & ((1 << depth) - 1))
            col = ((2 * place[key >> 1] + (key & 1)) << depth) + self.col[node]
            old = np.repeat(np.arange(len(level)), np.diff(met[0]))
            met_key = np.concatenate((2 * old + ((met[2] >> shift[old]) & 1), key[hit]))
            met_term, met_col, met_impact = (np.concatenate(x) for x in ((met[1], term[hit]), (met[2], col[hit]), (met[3], impact[hit])))
            on = self.children[node] != 0
            key, term, node, impact = key[on], term[on], node[on], impact[on]
            most = np.zeros(2 * len(level) * n_terms, np.int64)
            np.maximum.at(most, np.concatenate((key, met_key)) * n_terms + np.concatenate((term, met_term)), np.concatenate((impact, met_impact)))
            bound = most.reshape(-1, n_terms) @ weights
            goes_on = np.bincount(key, minlength=2 * len(level)) > 0
            ends = ~goes_on[met_key] & (bound[met_key] >= bar)
            if ends.any():  # no live node: all cells of these columns are met
                col, at = np.unique(met_col[ends], return_inverse=True)
                total = np.zeros(len(col), np.int64)
                np.add.at(total, at, weights[met_term[ends]] * met_impact[ends])
                ok = total >= bar
                cols.append(col[ok])
                scores.append(total[ok])
                known = np.concatenate(scores)
                if len(known) >= k:
                    bar = max(bar, int(np.partition(known, len(known) - k)[len(known) - k]))
            goes_on &= bound >= bar
            if goes_on.any():
                at = np.flatnonzero(goes_on)
                new = np.cumsum(goes_on) - 1
                pools.append((
                    level[at >> 1] + 1, 2 * place[at >> 1] + (at & 1), bound[at],
                    _rows(key, goes_on, new, len(at), term, node, impact), _rows(met_key, goes_on, new, len(at), met_term, met_col, met_impact),
                ))
                pools.sort(key=lambda pool: pool[2].max(initial=0))
        if not cols:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        col, total = np.concatenate(cols), np.concatenate(scores)
        return col[total >= bar], total[total >= bar]


def _rows(key: np.ndarray, keep: np.ndarray, new: np.ndarray, n: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Offsets of the ranges that are kept, and the columns in their order."""
    at = np.flatnonzero(keep[key])
    at = at[np.argsort(new[key[at]], kind="stable")]
    return np.concatenate(([0], np.cumsum(np.bincount(new[key[at]], minlength=n)))), *(c[at] for c in columns)


def _part(level, place, bound, live, met, chosen: np.ndarray):
    def rows(table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        sizes = np.diff(table[0])[chosen]
        ends = np.cumsum(sizes)
        at = np.repeat(table[0][chosen] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.concatenate(([0], ends)), *(c[at] for c in table[1:])

    return level[chosen], place[chosen], bound[chosen], rows(live), rows(met)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in batches:
        for _, w in textvec.words(batch.column(0), alnum=True):
            n = np.diff(w.doc)
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])


def count_corpus(docs: DataFrame) -> Corpus:
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_counted, "documents long, terms long")
    row = counted.agg(F.sum("documents"), F.sum("terms")).first()
    return Corpus(row[0] or 0, row[1] or 0)


def _block(corpus: Corpus, ids: list[int | None], hashes: list[np.ndarray], lengths: list[np.ndarray]) -> pa.RecordBatch:
    length = np.concatenate(lengths)
    terms, row = np.unique(np.concatenate(hashes), return_inverse=True)
    cell, tf = np.unique((row.astype(np.int64) << 32) | np.repeat(np.arange(len(length)), length), return_counts=True)
    row, col = cell >> 32, cell & 0xFFFFFFFF
    treap = K2Treap.build(row, col, corpus.impacts(tf, length[col]))
    packed = (terms.astype("<u8"), np.bincount(row, minlength=len(terms)).astype("<u4"))
    arrays = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in packed), pa.array([treap.bits], pa.int32())]
    arrays += [pa.array([x.tobytes()], pa.binary()) for x in (treap.children, treap.lacks, treap.row, treap.col)]
    return pa.RecordBatch.from_arrays(arrays, names=["docs", "terms", "df", "bits", "children", "lacks", "row", "col"])


def build_index(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """The index of all documents, written: a row for each block.

    Every row counts, equal ones too; null texts and those without terms hold none. Blocks are made where the rows
    are read, so nothing is shuffled, and a task holds one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, lengths, size = [], [], [], 0
        for batch in batches:
            for at, w in textvec.words(batch.column(1), alnum=True):
                n = np.diff(w.doc)
                k = 0
                while k < len(n):  # as many documents as the block may still hold, one at least
                    fit = int(np.searchsorted(w.doc[k + 1 :] - w.doc[k], BLOCK_TERMS - size, side="right"))
                    take = min(len(n) - k, BLOCK_DOCS - len(ids), max(fit, not ids))
                    if take > 0:
                        ids += batch.column(0).slice(at + k, take).to_pylist()
                        hashes.append(w.hash[w.doc[k] : w.doc[k + take]])
                        lengths.append(n[k : k + take])
                        size += len(hashes[-1])
                        k += take
                    if k < len(n):
                        yield _block(corpus, ids, hashes, lengths)
                        ids, hashes, lengths, size = [], [], [], 0
        if ids:
            yield _block(corpus, ids, hashes, lengths)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(run, INDEX), "index", compression="zstd")


def _terms_of(text: str | None) -> np.ndarray:
    return next((np.unique(w.hash) for _, w in textvec.words(pa.array([text], pa.string()), alnum=True)), np.zeros(0, np.uint64))


def _document_frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, df in zip(batch.column(0), batch.column(1), strict=True):
                own, df = np.frombuffer(own.as_buffer(), "<u8"), np.frombuffer(df.as_buffer(), "<u4")
                at = np.searchsorted(own, terms)
                at[at == len(own)] = 0
                if len(own):
                    total += np.where(own[at] == terms, df[at], 0)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "df"])

    return run


def _search(items, k: int):
    """``(item, doc_id, score)``: the k best of the blocks that a task reads, for each of the broadcast items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(len(batch)):
                ids = batch.column(0).slice(at, 1).flatten()
                own = np.frombuffer(batch.column(1)[at].as_buffer(), "<u8")
                kinds = ("<u1", "<u4", "<u4", "<u2" if batch.column(2)[at].as_py() <= 16 else "<u4")
                arrays = [np.frombuffer(batch.column(c)[at].as_buffer(), kind) for c, kind in enumerate(kinds, 3)]
                treap = K2Treap(batch.column(2)[at].as_py(), *arrays)
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                for item, (terms, weights) in enumerate(items.value):
                    row = np.searchsorted(own, terms)
                    known = row < len(own)
                    known[known] = own[row[known]] == terms[known]
                    known &= weights > 0
                    before = best.get(item)
                    bar = int(before[0][k - 1]) if before is not None and len(before[0]) >= k else 1
                    col, score = treap.best(row[known], weights[known], k, bar)
                    if len(col):
                        rows = (score, null[col], ids[col])
                        rows = rows if before is None else tuple(np.concatenate(x) for x in zip(before, rows, strict=True))
                        first = np.lexsort((rows[2], rows[1], -rows[0]))[:k]
                        best[item] = tuple(x[first] for x in rows)
        for item, (score, null, ids) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), item, np.int32)), pa.array(ids, pa.int64(), mask=null), pa.array(score)], names=["item", "doc_id", "score"]
            )

    return run


def search_index(index: DataFrame, corpus: Corpus, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item over an index of ``build_index()``.

    Items are dealt by a hash into groups of about ``ITEM_BYTES`` of text; each group is broadcast and searched in one
    pass over the index. Repeated items count once.
    """
    spark = index.sparkSession
    known = items.select("item_id", F.col("text").cast("string")).distinct()
    known = materialize(known.withColumn("dealt", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 30))), "items")
    size = known.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    groups = -(-size // ITEM_BYTES)
    ranked = None
    for group in range(groups):
        mine = known.filter(F.col("dealt") % groups == group).select("item_id", "text").collect()  # about ITEM_BYTES
        of = [_terms_of(r["text"]) for r in mine]
        terms = np.unique(np.concatenate([*of, np.zeros(0, np.uint64)]))
        counted = index.select("terms", "df").mapInArrow(_document_frequencies(terms), "term long, df long")
        df = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the items' terms
        weights = np.array([corpus.weight(df.get(term, 0)) for term in range(len(terms))], dtype=np.int64)
        shared = spark.sparkContext.broadcast([(x, weights[np.searchsorted(terms, x)]) for x in of])
        columns = ["docs", "terms", "bits", "children", "lacks", "row", "col"]
        found = index.select(*columns).mapInArrow(_search(shared, k), "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(mine)], f"item int, item_id {known.schema['item_id'].dataType.simpleString()}")
        part = found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        ranked = part if ranked is None else ranked.unionByName(part)
    if ranked is None:
        kind = known.schema["item_id"].dataType.simpleString()
        ranked = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return ranked


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each item: ``item_id, rank, doc_id, score``.

    Terms are runs of letters and digits (ASCII) and of all other code points from 0x80 on, A-Z lower-cased; a document
    scores the sum over the item's distinct terms of weight times impact, in integers. Ranks begin at 1; equal scores
    rank by doc_id, null ones last; rows that repeat a doc_id are documents of their own. Scores of 0 are left out, so
    items and documents that are null, empty or share no weighted term have no row; items that repeat id and text
    count once; whole texts of any length are indexed; empty tables give no rows. No other column is read.
    """
    corpus = count_corpus(docs)
    return search_index(build_index(docs, corpus), corpus, items, k)
