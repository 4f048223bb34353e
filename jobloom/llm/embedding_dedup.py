"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its ``PREFIX`` nearest reference points (pivots) and is listed under each of
them. Two vectors are candidates if they share at least ``SHARED`` pivots; a pair is handled in the list of
its lowest shared pivot only. Candidates are verified by their cosine in double precision.

Pivots are random directions with a fixed seed; their number follows the number of vectors. Equal vectors
form one class first. A list longer than ``LONG`` is split by a second pivot: since candidates share two, a
pair is then handled in the list of its two lowest shared pivots. What is still longer than ``BLOCK`` is
dealt into blocks, and a task compares two blocks: it returns link counts and the local component of each
vector, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.numbering import join_hint
from jobloom.llm.scratch import discard, materialize
from jobloom.operators.components import connected_components

PREFIX, SHARED, BLOCK, LONG = 8, 2, 512, 1024
LEAST_PIVOTS, VECTORS_PER_PIVOT = 64, 100
#: Beyond so many pivots their number grows as the fourth root of the vectors, since long lists are split.
SLOWER_PIVOTS = 2048


def pivots_for(vectors: int) -> int:
    """The number of pivots, a power of two."""
    n = max(LEAST_PIVOTS, vectors / VECTORS_PER_PIVOT)
    if n > SLOWER_PIVOTS:
        n = SLOWER_PIVOTS * (n / SLOWER_PIVOTS) ** 0.25
    return 1 << (int(np.ceil(n)) - 1).bit_length()


def pivots(dimension: int, n: int) -> np.ndarray:
    """Unit vectors in random directions, the same everywhere."""
    drawn = np.random.default_rng(dimension).normal(size=(n, dimension))
    return drawn / np.linalg.norm(drawn, axis=1)[:, None]


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _describe(n_pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.array([len(v) for v in vectors], dtype=np.int64)
            for dimension in np.unique(sizes):
                where = pa.array(np.flatnonzero(sizes == dimension))
                x = _matrix(vectors.take(where), int(dimension))
                x /= np.abs(x).max(axis=1)[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                if dimension not in points:
                    points[dimension] = pivots(int(dimension), n_pivots)
                near = np.argsort(-(x @ points[dimension].T), axis=1, kind="stable")[:, : min(PREFIX, n_pivots)]
                unit = pa.array(list(x), pa.list_(pa.float64()))
                described = pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(2).take(where), unit, described],
                    names=["cid", "copies", "unit", "near"],
                )

    return run


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        pivot, second, dimension = (table.column(c)[0].as_py() for c in ("pivot", "second", "dimension"))
        ids, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        side, x = table.column("side").to_numpy(), _matrix(table.column("unit"), dimension)
        near = table.column("near").combine_chunks()
        near = near.flatten().to_numpy().reshape(len(ids), -1)
        first = side == side.min()
        rows = np.flatnonzero(first)
        cols = rows if first.all() else np.flatnonzero(~first)
        place = np.full((2, len(ids)), -1)
        place[0, rows], place[1, cols] = np.arange(len(rows)), np.arange(len(cols))
        shared = np.zeros((len(rows), len(cols)), dtype=np.uint8)
        owner = np.repeat(np.arange(len(ids)), near.shape[1])
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        cuts = np.flatnonzero(np.diff(flat[order])) + 1
        elsewhere = np.zeros_like(shared, dtype=bool)  # pairs with lower shared pivots
        for members, q in zip(np.split(owner[order], cuts), flat[order][np.concatenate(([0], cuts))], strict=True):
            r, c = place[0, members], place[1, members]
            cell = np.ix_(r[r >= 0], c[c >= 0])
            shared[cell] += 1
            if q < pivot or pivot < q < second:
                elsewhere[cell] = True
        candidate = (shared >= SHARED) & ~elsewhere
        linked = candidate & (x[rows] @ x[cols].T >= threshold) & (ids[rows][:, None] != ids[cols][None, :])
        a, b = np.nonzero(linked)
        a, b = rows[a], cols[b]
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, a, copies[b])
        if cols is not rows:
            np.add.at(links, b, copies[a])
        root = np.arange(len(ids))
        while len(a):
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        some = np.flatnonzero(links)
        return pa.table({"cid": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def embedding_components(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Links and components of ``vectors(vec_id, embedding, ...)`` by cosine.

    Returns one row per input row: ``vec_id, n_links, component_id, kept``. A vector that is null, empty,
    zero, or holds null or non-finite components links with nothing, as does a null vec_id; vectors of
    different length are never linked. Rows that repeat a vector count as other vectors. Other columns are
    ignored.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    big = F.lit(float("inf"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < big))
    usable = F.coalesce(finite & F.exists("v", lambda e: e != 0.0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("k1", F.when(usable, F.xxhash64("v"))).withColumn(
        "k2", F.when(usable, F.xxhash64(F.lit("second"), F.col("v")))
    )
    rows = materialize(rows, "vectors")
    classes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.first("v").alias("v")
    )
    classes = materialize(classes, "vector-classes")
    n_pivots = pivots_for(classes.count())
    described = classes.select("cid", "v", "copies").mapInArrow(
        _describe(n_pivots), "cid long, copies long, unit array<double>, near array<int>"
    )
    described = materialize(described.withColumn("dimension", F.size("unit")), "described")
    lengths = described.select("dimension", F.explode("near").alias("pivot")).groupBy("pivot", "dimension")
    lengths = materialize(lengths.agg((F.count("*") > LONG).alias("long")), "lengths")
    further = F.filter("near", lambda q: q > F.col("pivot"))  # the lowest shared pivot comes first
    seconds = F.when(F.col("long"), further).otherwise(F.array(F.lit(-1)))  # -1: the list is not split
    listed = described.withColumn("pivot", F.explode("near")).join(lengths.hint(join_hint(lengths.count())), ["pivot", "dimension"])
    listed = listed.withColumn("second", F.explode(seconds)).drop("long")
    sizes = listed.groupBy("pivot", "second", "dimension").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = materialize(sizes, "list-sizes")
    listed = listed.join(sizes.hint(join_hint(sizes.count())), ["pivot", "second", "dimension"])
    listed = listed.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    listed = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    listed = listed.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    found = (
        listed.select("cid", "copies", "unit", "near", "pivot", "second", "dimension", "side", "i", "j")
        .groupBy("pivot", "second", "dimension", "i", "j")
        .applyInArrow(_compare(threshold), "cid long, links long, root long")
    )
    found = materialize(found, "vector-links")
    discard(lengths, sizes, described)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    components = connected_components(found.selectExpr("cid as a", "root as b"))
    known = classes.select("k1", "k2", "cid", "copies").join(counts, "cid", "left").join(
        components, F.col("cid") == F.col("node"), "left"
    )
    known = known.select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "cid").alias("c"),
    )
    joined = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.coalesce("c", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
