"""Run logs: per-source results, execution grades, error digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cap_per_source(df: DataFrame, most: int, source: str = "source", order: str | Column = "item_idx") -> DataFrame:
    """The first ``most`` items of each source."""
    place = Window.partitionBy(source).orderBy(order)
    return df.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= most).drop("_n")


def source_runs(items: DataFrame, sources: DataFrame) -> DataFrame:
    """``items(source, item_idx, ok, error)`` per source: jobs found, errors, status and message."""
    counts = items.groupBy("source").agg(
        F.count_if("ok").alias("jobs_found"), F.count_if(~F.col("ok")).alias("errors")
    )
    digests = first_messages(items).groupBy("source").agg(error_digest("error", "item_idx").alias("digest"))
    joined = sources.select("source").join(counts, "source", "left").join(digests, "source", "left")
    found, errors = F.coalesce("jobs_found", F.lit(0)), F.coalesce("errors", F.lit(0))
    return joined.select(
        "source",
        found.alias("jobs_found"),
        errors.alias("errors"),
        F.when(found == 0, "failed").when(errors > 0, "partial").otherwise("success").alias("status"),
        F.coalesce("digest", F.when(found == 0, F.concat(F.lit("No jobs found for "), "source"))).alias("message"),
    )


def first_messages(items: DataFrame) -> DataFrame:
    """The first messages of each source, as many as ``error_digest`` can show.

    Each adds its separator of two characters, so 1,001 give 2000 at least. Parts of a source are cut first,
    which bounds what a source with very many errors brings to one task.
    """
    held = items.select("source", "item_idx", "error").filter("error IS NOT NULL")
    held = held.withColumn("_part", F.pmod(F.xxhash64("item_idx", "error"), F.lit(64)))
    for keys in (["source", "_part"], ["source"]):
        place = Window.partitionBy(*keys).orderBy("item_idx", "error")
        held = held.withColumn("_n", F.row_number().over(place)).filter("_n <= 1001").drop("_n")
    return held.drop("_part")


def error_digest(message: str, order: str) -> Column:
    """Messages of a group in order, joined with ``"; "`` and cut at 2000 characters; null without any."""
    held = F.array_sort(F.collect_list(F.when(F.col(message).isNotNull(), F.struct(order, message))))
    text = F.left(F.array_join(F.transform(held, lambda x: x[message]), "; "), F.lit(2000))
    return F.when(F.size(held) > 0, text)


def execution_summary(runs: DataFrame, rule: str = "pipeline", by: str = "execution_id") -> DataFrame:
    """``runs(execution_id, jobs_found, status, scored, issues)`` rolled up and graded.

    Rule ``pipeline``: failed if there are issues and nothing succeeded, partial if there are issues;
    ``refresh``: failed if nothing was found, partial if a source or scoring failed.
    """
    if rule not in ("pipeline", "refresh"):
        raise ValueError(f"unknown rule {rule!r}")
    rolled = runs.groupBy(by).agg(
        F.sum("jobs_found").alias("jobs_found"), F.sum("scored").alias("scored"), F.sum("issues").alias("issues"),
        F.count_if(F.col("status") != "success").alias("bad_sources"), F.count("*").alias("sources"),
    )
    if rule == "pipeline":
        grade = F.when((F.col("issues") > 0) & (F.col("scored") == 0), "failed").when(F.col("issues") > 0, "partial")
    else:
        grade = F.when(F.col("jobs_found") == 0, "failed").when((F.col("bad_sources") > 0) | (F.col("issues") > 0), "partial")
    return rolled.withColumn("status", grade.otherwise("success"))


def sync_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if("ok").alias("synced"), F.count_if(~F.col("ok")).alias("failed"))
