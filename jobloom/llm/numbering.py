"""Gapless numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.scratch import materialize

#: A task sorts about this many rows of one key.
ROWS_PER_GROUP = 20_000
#: Tables of up to this many small rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def join_hint(rows: int) -> str:
    """The hint for the smaller side of a join, of ``rows`` small rows."""
    return "broadcast" if rows <= BROADCAST_ROWS else "shuffle_hash"


def gapless(df: DataFrame, keys: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each value of ``keys``; with ``weight`` a row takes so many numbers.

    ``order`` must tell the rows of a key apart. A key of more than ``ROWS_PER_GROUP`` rows is dealt by a hash
    of ``order`` into groups of about that size; these are counted first, so that each knows where its numbers
    begin, and only a group is sorted in one task. No join is on a bare key: rows get the counts of large keys,
    of which there are few, by a broadcast of checked size, and other keys need none. ``df`` should be a table
    that gives the same rows when read again.
    """
    taken = F.col(weight) if weight else F.lit(1)
    large = df.groupBy(*keys).agg(F.ceil(F.count("*") / ROWS_PER_GROUP).cast("int").alias("_salts")).filter("_salts > 1")
    large = materialize(large, "large-keys")
    groups = large.agg(F.sum("_salts")).first()[0] or 0
    salt, begin = F.lit(0), F.lit(0)
    if groups:
        salted = df.join(large.hint(join_hint(groups)), keys)
        salted = salted.select(*keys, F.pmod(F.xxhash64(*order), "_salts").cast("int").alias("_salt"), taken.alias("_n"))
        none = large.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(0).alias("_n"))
        counts = salted.unionByName(none).groupBy(*keys, "_salt").agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        begins = F.transform(F.array_sort(F.collect_list(F.struct("_salt", "_begin"))), lambda x: x["_begin"])
        begins = materialize(counts.groupBy(*keys).agg(begins.alias("_begins")), "begins")
        df = df.join(begins.hint(join_hint(groups)), keys, "left")
        salt = F.coalesce(F.pmod(F.xxhash64(*order), F.size("_begins")), F.lit(0)).cast("int")
        begin = F.coalesce(F.get("_begins", F.col("_salt")), F.lit(0))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn("_salt", salt).withColumn(name, (begin + F.coalesce(F.sum(taken).over(within), F.lit(0))).cast("long"))
    return numbered.drop("_salt", "_begins")
