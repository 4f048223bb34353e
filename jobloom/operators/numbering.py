"""One gapless order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.sources.scratch import materialize

_WITHIN = 33  #: low bits of Spark's increasing ids: the place within a partition


def number_rows(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Add ``name``: ``first``, ``first + 1``, ... in the order of the columns ``order``, nulls first.

    Rows are dealt by ranges of the order, each range is sorted in its task, and ranges begin where the counts of the
    ones before end. Rows that tie are ordered by a hash of all columns, so that a value which very many rows share
    is dealt over several ranges; which of two equal rows comes first makes no difference.
    """
    tie = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]) if df.columns else F.lit(0)
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("_tie").asc()]
    ranged = df.withColumn("_tie", tie).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    placed = materialize(ranged.sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).drop("_tie"), "ranged")
    part = F.shiftrightunsigned("_id", _WITHIN)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    joined = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return joined.withColumn(name, F.col("_begin") + F.col("_id").bitwiseAND((1 << _WITHIN) - 1) + first).drop("_part", "_begin", "_id")
