"""Sharding of documents by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts stay together. What is packed is the histogram of group sizes, exact for every group
and with at most sqrt(2 * bytes) entries: runs of groups of equal size, largest first, enter the bin with
the tightest remaining capacity, found in a balanced tree. A group that would fill a shard gets its own.
The capacity is the least at which the bins suffice. A run names ranks of groups within their size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.numbering import gapless, join_hint
from jobloom.llm.scratch import discard, materialize


class Run(NamedTuple):
    """Groups of ``size`` with ranks from ``lo`` to below ``hi`` go to ``shard``."""

    size: int
    lo: int
    hi: int
    shard: int


class Capacities:
    """A balanced (AVL) tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _balanced(self, node: list) -> list:
        def sized(x: list) -> list:
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
            return x

        def turned(x: list, up: int) -> list:
            child, down = x[up], 3 - up
            x[up], child[down] = child[down], x
            sized(x)
            return sized(child)

        sized(node)
        for up, down in ((1, 2), (2, 1)):
            child = node[up]
            if self._height(child) > self._height(node[down]) + 1:
                if self._height(child[down]) > self._height(child[up]):
                    node[up] = turned(child, down)
                return turned(node, up)
        return node

    def add(self, key: tuple[int, int]) -> None:
        def into(node: list | None) -> list:
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = into(node[side])
            return self._balanced(node)

        self.root = into(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def out_of(node: list, key: tuple[int, int]) -> list | None:
            if key == node[0]:
                if not (node[1] and node[2]):
                    return node[1] or node[2]
                least = node[2]
                while least[1]:
                    least = least[1]
                node[0] = least[0]
                node[2] = out_of(node[2], least[0])
            else:
                side = 1 if key < node[0] else 2
                node[side] = out_of(node[side], key)
            return self._balanced(node)

        self.root = out_of(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least remaining capacity of at least ``size``."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                node, found = node[1], node[0]
            else:
                node = node[2]
        return found


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int) -> list[Run] | None:
    """Bins for all groups of ``sizes`` (size, groups), largest first, or None if ``most`` bins do not suffice."""
    tree, used, runs = Capacities(), 0, []
    for size, groups in sizes:
        lo = 0
        while lo < groups:
            at = tree.tightest(size)
            if at is None:
                if used == most or size > capacity:
                    return None
                room, number = capacity, used
                used += 1
            else:
                tree.remove(at)
                room, number = at
            hi = min(groups, lo + room // size)
            tree.add((room - (hi - lo) * size, number))
            runs.append(Run(size, lo, hi, number))
            lo = hi
    return runs


def plan(histogram: dict[int, int], shards: int) -> list[Run]:
    """Shards for all groups of a histogram of sizes: near-equal bytes in exactly as many bins as there are shards."""
    sizes = sorted(histogram.items(), reverse=True)
    alone: list[Run] = []
    total = sum(size * groups for size, groups in sizes)
    while sizes and shards - len(alone) > 1 and sizes[0][0] * (shards - len(alone)) >= total:
        size, groups = sizes[0]  # as large as a shard
        met = sum(run.size == size for run in alone)
        alone.append(Run(size, met, met + 1, len(alone)))
        total -= size
        sizes = ([(size, groups - 1)] if groups > 1 else []) + sizes[1:]
    bins = shards - len(alone)
    least = max([-(-total // bins), *(size for size, _ in sizes[:1])])
    low, step = least, 1
    packed = best_fit_decreasing(sizes, low, bins)
    while packed is None:  # then the capacity lies in (low, low + step]
        low, step = low + step, step * 2
        packed = best_fit_decreasing(sizes, low, bins)
    below, high = low - step // 2, low
    while below + 1 < high:
        middle = (below + high) // 2
        found = best_fit_decreasing(sizes, middle, bins)
        below, high, packed = (middle, high, packed) if found is None else (below, middle, found)
    met = {size: sum(run.size == size for run in alone) for size in {run.size for run in alone}}
    rest = [Run(r.size, r.lo + met.get(r.size, 0), r.hi + met.get(r.size, 0), r.shard + len(alone)) for r in packed]
    return alone + rest


def _keys(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text``, a hash of the text, and ``_row``, one of text and doc_id, in front of the whole row."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(
        F.xxhash64(text).alias("_text"),  # a collision only keeps two groups together
        F.xxhash64(F.lit("row"), doc_id.isNull(), doc_id, text).alias("_row"),
        doc_id.alias("_doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("_size"),
        F.struct("*").alias("row"),
    )


def shard_places(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The written table ``_text, _row, shard, slot, n``: rows with that text and doc_id take ``n`` slots from ``slot`` on."""
    rows = _keys(docs).groupBy("_text", "_row").agg(F.count("*").alias("n"), F.min("_doc_id").alias("_doc_id"), F.min("_size").alias("size"))
    rows = materialize(rows, "rows")
    groups = materialize(rows.groupBy("_text").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), "groups")
    histogram = {r["bytes"]: r["n"] for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, shards) or [Run(0, 0, 0, 0)]
    columns = dict(zip(("size", "lo", "hi", "shard"), np.array(runs, dtype=np.int64).T, strict=True))
    table = docs.sparkSession.createDataFrame(pa.table({name: pa.array(c) for name, c in columns.items()})).withColumnRenamed("size", "of")
    ranked = gapless(groups, ["bytes"], ["_text"], "rank")
    inside = (F.col("bytes") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(table.hint(join_hint(len(runs))), inside).select("_text", F.col("shard").cast("int").alias("shard"))
    placed = materialize(rows.join(placed, "_text").drop("size"), "placed")
    places = materialize(gapless(placed, ["shard"], ["_doc_id", "_text", "_row"], "slot", weight="n").drop("_doc_id"), "places")
    discard(rows, groups, placed)
    return places


def shard_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put the rows of ``docs(doc_id, text, ...)`` into ``shards`` shards of near-equal bytes.

    Returns the written table ``shard, slot, row``: a folder for each shard, a gapless place in it and the
    whole row with all its columns. A row counts the UTF-8 bytes of its text plus 8. Null and empty texts
    form one group. Every row gets a place, repeated rows and null ids too; an empty table gives no rows.
    One text with a large share of all bytes takes a shard alone, and the others share the rest equally.
    ``docs`` should be a table that gives the same rows when read again; places depend on doc_id and text
    alone, and whole rows are moved by one join.
    """
    places = shard_places(docs, shards)
    whole = _keys(docs).drop("_doc_id", "_size").join(places, ["_text", "_row"])
    once, often = whole.filter("n = 1"), places.filter("n > 1")
    if not often.isEmpty():  # rows that repeat both text and doc_id take their slots in any order
        nth = F.row_number().over(Window.partitionBy("_text", "_row").orderBy(F.lit(0))) - 1
        again = _keys(docs).drop("_doc_id", "_size").join(often, ["_text", "_row"]).withColumn("slot", F.col("slot") + nth)
        once = once.unionByName(again)
    once = materialize(once.select("slot", "row", "shard"), "shards", by="shard", compression="zstd").select("shard", "slot", "row")
    discard(places)
    return once


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The digest of ``shard_rows()``, read from the written shards.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the UTF-8 bytes of the text plus 8
    (null: 8, with the checksum of the empty text), the law ``bytes``, and the place in the shard.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return shard_rows(docs, shards).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
