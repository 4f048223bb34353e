"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobloom.functions.links import canonicalize_url, fingerprint
from jobloom.operators.ledger import LEDGER, Ledger
from jobloom.operators.pipeline import FIELDS, place
from jobloom.sources.feeds import paged, read_feeds
from jobloom.sources.store import BucketStore

FEED_SCHEMA = "source string, base_url string, default_company string, payload string, page long"


def ingest_feeds(spark: SparkSession, folder: str, checkpoint: str, store: Callable[[DataFrame, DataFrame, int], None]) -> None:
    """Hand the postings and the quarantined rows of new feed files to ``store(good, bad, batch)``; then stop.

    The checkpoint remembers the files, so that a second call without new files stores nothing. ``store``
    gets the batch number to make repeated writes idempotent.
    """
    def one(batch: DataFrame, number: int) -> None:
        good, bad = read_feeds(paged(batch))
        store(good, bad, number)

    stream = spark.readStream.schema(FEED_SCHEMA).json(folder)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: A sighting as the ledger keeps it.
SIGHTING = (
    "seq string, source string, title string, company string, description string, description_url string, application_url string, "
    "canonical_url string, location string, region string, modality string, salary_min double, salary_max double, salary_currency string, "
    "salary_period string, published_at date, fingerprint string, metadata map<string,string>, checked_at timestamp"
)


def posting_ledger(spark: SparkSession, root: str, buckets: int = 64) -> Ledger:
    """The ledger of the postings under ``root``."""
    return Ledger(BucketStore(spark, f"{root}/ledger", LEDGER, buckets), [*FIELDS, "fingerprint"], StructType.fromDDL(SIGHTING))


def ingest_into(spark: SparkSession, folder: str, checkpoint: str, root: str, buckets: int = 64) -> None:
    """Upsert the postings of new feed files into the ledger under ``root``: ``posting_ledger(spark, root).postings()``.

    A batch meets only the keys and postings that it touches and writes their buckets anew; it never reads the
    sightings of other batches, which are kept by batch under ``root/sightings``, as are quarantined rows. A batch that is
    run again starts from the ledger before it and writes the same folders, so it adds nothing.
    """
    ledger = posting_ledger(spark, root, buckets)

    def store(good: DataFrame, bad: DataFrame, number: int) -> None:
        keyed = good.withColumns({
            "seq": place(number, F.col("source"), F.col("page"), F.col("item_idx")),
            "canonical_url": F.coalesce(canonicalize_url(F.col("canonical_url")), F.col("canonical_url")),
            "fingerprint": fingerprint(F.col("title"), F.col("company"), F.col("location")),
            "checked_at": F.current_timestamp(),
        })
        kinds = {f.name: f.dataType for f in StructType.fromDDL(SIGHTING).fields}
        kept = keyed.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
        kept.write.mode("overwrite").parquet(f"{root}/sightings/batch={number}")
        bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch={number}")
        ledger.ingest(spark.read.schema(SIGHTING).parquet(f"{root}/sightings/batch={number}"), number)

    ingest_feeds(spark, folder, checkpoint, store)


def suppress_duplicates(postings: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of ``postings(detected_at, url, ...)`` without later copies of a canonical URL within ``delay``."""
    keyed = postings.withColumns({
        "canonical_url": F.coalesce(canonicalize_url(F.col("url")), F.col("url")),
        "detected_at": F.col("detected_at").cast("timestamp"),
    })
    return keyed.withWatermark("detected_at", delay).dropDuplicatesWithinWatermark(["canonical_url"])
