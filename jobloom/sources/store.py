"""Tables in buckets of a key, of which an update writes anew only those that it touches.

``root/<table>/version=V/bucket=B`` holds the rows of a bucket as update V left them. ``root/manifests/V.json`` says which
version of each bucket is current after update V; it is written last and renamed into place, so a reader sees an
update whole or not at all. An update that is run again reads what it read the first time and writes the same folders.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Manifest = dict[str, dict[int, int]]


class BucketStore:
    """``keys`` names the column that deals each table's rows into ``buckets``."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(self.keys[table]), F.lit(self.buckets)).cast("int")

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def updates(self) -> list[int]:
        """The numbers of the updates that are in place."""
        at, files = self._files(f"{self.root}/manifests")
        if not files.exists(at):
            return []
        names = [status.getPath().getName() for status in files.listStatus(at)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def manifest(self, before: int | None = None) -> Manifest:
        """The current versions, or those that update ``before`` found."""
        done = [number for number in self.updates() if before is None or number < before]
        if not done:
            return {}
        lines = self.spark.read.text(f"{self.root}/manifests/{done[-1]:012d}.json", wholetext=True).first()[0]
        return {table: {int(b): v for b, v in held.items()} for table, held in json.loads(lines).items()}

    def read(self, table: str, schema: StructType | str, manifest: Manifest, touched: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets only."""
        held = manifest.get(table, {})
        wanted = sorted(held if touched is None else set(touched) & held.keys())
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/version={held[b]}/bucket={b}" for b in wanted])

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall into: numbers below ``buckets``."""
        return [r[0] for r in rows.select(self.bucket(table)).distinct().collect()]

    def replace(self, table: str, number: int, rows: DataFrame, touched: list[int], manifest: Manifest) -> None:
        """Write all rows of the touched buckets; ``manifest`` then names their new version."""
        # A task for each bucket: a hash of few numbers would leave tasks idle and give others several.
        place = (F.array_position(F.lit(touched or [0]), F.col("bucket")) - 1).cast("int")
        dealt = rows.withColumn("bucket", self.bucket(table)).repartitionById(max(1, len(touched)), place)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/version={number}")
        at, files = self._files(f"{self.root}/{table}/version={number}")
        there = {int(s.getPath().getName()[7:]) for s in files.listStatus(at) if s.getPath().getName().startswith("bucket=")}
        held = manifest.setdefault(table, {})
        for bucket in touched:
            held.pop(bucket, None)  # it may have lost all its rows
        held.update(dict.fromkeys(there, number))

    def publish(self, number: int, manifest: Manifest) -> None:
        """Make an update the current one."""
        text = json.dumps({table: {str(b): v for b, v in sorted(held.items())} for table, held in sorted(manifest.items())})
        at, files = self._files(f"{self.root}/manifests/_{number:012d}.json")
        out = files.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._files(f"{self.root}/manifests/{number:012d}.json")
        if files.exists(final):
            files.delete(final, False)
        if not files.rename(at, final):
            raise OSError(f"could not publish update {number} of {self.root}")
