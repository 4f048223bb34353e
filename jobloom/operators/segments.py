"""Scans along a key's rows in order, for keys of any size.

A key's rows are dealt into segments by ranges of the order, of about ``SEGMENT_ROWS`` rows. What a scan carries is
first gathered for each segment, then handed on from segment to segment, and then each segment is scanned on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.sources.scratch import materialize

#: A task sorts about as many rows of a key.
SEGMENT_ROWS = 50_000
#: The splits of large keys, of which there are few, are broadcast up to as many of them.
BROADCAST_SPLITS = 500_000


def segmented(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``segment``: 0 for keys of up to ``SEGMENT_ROWS`` rows, else the place of the row's range of ``order``.

    Ranges are cut at approximate quantiles, so segments differ in size, but a key's rows are never out of order: equal
    values of ``order`` share a segment. ``df`` should be a table that gives the same rows when read again.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > SEGMENT_ROWS)
    large = materialize(sizes.withColumn("parts", F.ceil(F.col("n") / SEGMENT_ROWS).cast("int")).drop("n"), "large-keys")
    total = large.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    if not total:
        return df.withColumn("segment", F.lit(0))
    hint = "broadcast" if total <= BROADCAST_SPLITS else "shuffle_hash"
    # Quantiles of a sample that grows with the key: some hundred rows for each of its segments.
    place = F.pmod(F.xxhash64(order, F.lit("segment")), F.lit(SEGMENT_ROWS)) < 200
    drawn = df.filter(place).join(large.hint(hint), key).select(key, order, "parts")
    line = Window.partitionBy(key).orderBy(order)
    ranked = drawn.select(key, order, F.floor(F.percent_rank().over(line) * F.col("parts")).cast("int").alias("part"))
    firsts = ranked.filter("part > 0").groupBy(key, "part").agg(F.min(order).alias("begins"))
    splits = firsts.groupBy(key).agg(F.array_sort(F.collect_list("begins")).alias("_splits"))
    splits = materialize(splits, "splits")
    joined = df.join(splits.hint(hint), key, "left")
    reached = F.size(F.filter("_splits", lambda begin: begin <= F.col(order)))
    return joined.withColumn("segment", F.when(F.col("_splits").isNull(), 0).otherwise(reached)).drop("_splits")


def carried(rows: DataFrame, key: str, order: str, last: dict[str, Column], counts: dict[str, Column] | None = None) -> DataFrame:
    """What each segment of ``rows`` begins with: the last non-null value of each of ``last`` in the segments of its key before,
    and the sums of ``counts``; under these names.

    One row a segment comes together for each key.
    """
    at = F.col(order)
    held = [F.max(F.when(c.isNotNull(), F.struct(at, c.alias("x"))))["x"].alias(name) for name, c in last.items()]
    held += [F.sum(c).alias(name) for name, c in (counts or {}).items()]
    ends = rows.groupBy(key, "segment").agg(*held)
    before = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    handed = [F.last(name, ignorenulls=True).over(before).alias(name) for name in last]
    handed += [F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in counts or {}]
    return ends.select(key, "segment", *handed)
