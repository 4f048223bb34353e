"""Where operators write intermediate tables.

A written table cuts lineage and survives the loss of an executor. The folder is the one that the
cluster names in ``spark.checkpoint.dir``; a local session without that setting gets a temporary folder. Tables
that a later one replaces are deleted at once, the others when the application ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a task holds of the table that it writes.
ROW_GROUP_BYTES = 32 << 20

_local: dict[str, str] = {}
_kept: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/jobloom-{sc.applicationId}"


def materialize(df: DataFrame, name: str, by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; ``by`` names its last column for folders.

    The planner takes a file's bytes for a table's size and broadcasts what is small by that. Numbers that repeat shrink
    a hundredfold in a file and not in a broadcast, so tables of numbers alone are written plain unless told otherwise.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark)
    if folder not in _kept:
        at, files = _store(spark, folder)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _kept.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    # A row may be large: the first check of what is held comes after one row and not after a hundred.
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size.row.check.min", 1)
    if compression is None and not re.search(r"string|char|binary|variant", df.schema.simpleString()):
        writer, compression = writer.option("parquet.enable.dictionary", "false"), "uncompressed"
    writer.parquet(path, partitionBy=by, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize()`` that nothing reads any more."""
    for table in tables:
        at, files = _store(table.sparkSession, table._scratch_path)
        files.delete(at, True)


def _store(spark: SparkSession, path: str):
    """The path and the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
