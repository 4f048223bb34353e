"""Comparison of local postings with an external mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The properties of a mirrored posting.
PROPERTIES = (
    "Title", "Company", "Region", "Modality", "Location", "Requirements", "Salary min", "Salary max",
    "Salary currency", "Salary period", "Source", "Description URL", "Application URL", "Canonical URL",
    "Published", "Detected", "Checked", "Compatibility score", "Score explanation", "Matches", "Gaps",
    "Recommendations", "Status", "Local job ID", "Fingerprint",
)
_TEXT = {
    "Title": "title", "Company": "company", "Location": "location", "Source": "source",
    "Score explanation": "explanation", "Fingerprint": "fingerprint",
}
_LISTS = {"Requirements": "requirements", "Matches": "matches", "Gaps": "gaps", "Recommendations": "recommendations"}
_LINKS = {"Description URL": "description_url", "Application URL": "application_url", "Canonical URL": "canonical_url"}
_PLAIN = {
    "Region": ("region", "other"), "Modality": ("modality", "unknown"), "Status": ("status", "active"),
    "Salary currency": ("salary_currency", None), "Salary period": ("salary_period", None),
}
_NUMBERS = {"Salary min": "salary_min", "Salary max": "salary_max", "Compatibility score": "score"}
_DATES = {"Published": "published_at", "Detected": "detected_at", "Checked": "checked_at"}


def to_mirror_rows(jobs: DataFrame) -> DataFrame:
    """Postings (with their evaluation columns) as the mirror's 25 properties; missing columns give null.

    Lists are joined with ``", "``, texts and links cut to 2000 characters, blanks become null.
    """
    have = set(jobs.columns)

    def of(name: str, kind: str = "string"):
        return F.col(name) if name in have else F.lit(None).cast(kind)

    columns = {}
    for prop, c in _TEXT.items():
        columns[prop] = F.nullif(F.left(of(c).cast("string"), F.lit(2000)), F.lit(""))
    for prop, c in _LISTS.items():
        columns[prop] = F.nullif(F.left(F.array_join(of(c, "array<string>"), ", "), F.lit(2000)), F.lit(""))
    for prop, c in _LINKS.items():
        columns[prop] = F.nullif(F.left(of(c), F.lit(2000)), F.lit(""))
    for prop, (c, default) in _PLAIN.items():
        value = F.nullif(of(c), F.lit(""))
        columns[prop] = F.coalesce(value, F.lit(default)) if default else value
    for prop, c in _NUMBERS.items():
        columns[prop] = of(c, "double").cast("double")
    for prop, c in _DATES.items():
        columns[prop] = of(c).cast("string")
    columns["Local job ID"] = of("job_id", "long").cast("string")
    return jobs.select(*[columns[p].alias(p) for p in PROPERTIES])


def reconcile(local: DataFrame, pages: DataFrame, fields: list[str]) -> DataFrame:
    """Differences between ``local(job_id, fingerprint, ...)`` and ``pages(page_id, fingerprint, local_id, ...)``.

    A row is matched by fingerprint, else by id. Kinds: ``missing`` (no page, retryable), ``stale`` (fields
    differ, retryable) and ``orphan`` (a page that matched nothing, never retried or deleted).
    """
    by_print = pages.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("page_id").alias("_p"))
    by_id = pages.filter("local_id is not null").groupBy("local_id").agg(F.min("page_id").alias("_q"))
    keyed = local.withColumn("local_id", F.col("job_id").cast("string"))
    matched = keyed.join(by_print, "fingerprint", "left").join(by_id, "local_id", "left")
    matched = matched.withColumn("page_id", F.coalesce("_p", "_q"))
    none = F.array().cast("array<struct<field:string,expected:string,actual:string>>")
    missing = matched.filter("page_id is null").select(
        F.lit("missing").alias("kind"), "job_id", F.lit(None).cast("long").alias("page_id"), none.alias("fields"), F.lit(True).alias("retryable")
    )
    there = pages.select("page_id", *[F.col(f).cast("string").alias(f"_{f}") for f in fields])
    pairs = matched.filter("page_id is not null").join(there, "page_id")
    differing = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("expected"), F.col(f"_{f}").alias("actual")) for f in fields]),
        lambda d: ~d["expected"].eqNullSafe(d["actual"]),
    )
    stale = pairs.withColumn("fields", differing).filter(F.size("fields") > 0)
    stale = stale.select(F.lit("stale").alias("kind"), "job_id", "page_id", "fields", F.lit(True).alias("retryable"))
    used = matched.filter("page_id is not null").select("page_id").distinct()
    orphan = pages.join(used, "page_id", "left_anti").select(
        F.lit("orphan").alias("kind"), F.lit(None).cast("long").alias("job_id"), "page_id", none.alias("fields"), F.lit(False).alias("retryable")
    )
    return missing.unionByName(stale).unionByName(orphan)


def reconcile_summary(differences: DataFrame, pages: DataFrame) -> DataFrame:
    counts = differences.agg(
        F.count("*").alias("differences"), F.count_if("retryable").alias("retryable_count"), F.count_if(F.col("kind") == "orphan").alias("orphan_count")
    )
    state = F.when(F.col("differences") > 0, "drift").otherwise("clean").alias("state")
    total = pages.agg(F.count("*").alias("page_count"))
    return counts.crossJoin(total).select("page_count", "retryable_count", "orphan_count", state)  # single rows


def repair_plan(differences: DataFrame, local: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Result of each repair: skipped, failed (with a reason) or repaired, from ``outcomes(job_id, ok)``."""
    known = local.select("job_id").distinct().withColumn("_local", F.lit(True))
    tried = outcomes.groupBy("job_id").agg(F.bool_and("ok").alias("_ok"))
    joined = differences.join(known, "job_id", "left").join(tried, "job_id", "left")
    result = (
        F.when(~F.col("retryable"), "skipped").when(F.col("_local").isNull(), "failed")
        .when(F.coalesce("_ok", F.lit(False)), "repaired").otherwise("failed")
    )
    error = F.when(F.col("retryable") & F.col("_local").isNull(), "local_job_not_found").when(
        F.col("retryable") & ~F.coalesce("_ok", F.lit(False)), "attempt_failed"
    )
    return joined.select(*differences.columns, result.alias("result"), error.alias("error"))


def repair_state(plan: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("result") == "failed")
    return plan.agg(F.when(F.count("*") == 0, "clean").when(failed > 0, "repair_failed").otherwise("repaired").alias("state"), failed.alias("failed"))
