"""Listings: filters, best and latest scores, pages, details, metrics, executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SORTS = ("detected_at", "published_at", "score", "title", "company")
MODALITIES = ("remote", "hybrid", "onsite", "unknown")


def filter_jobs(jobs: DataFrame, region: str | None = None, modality: str | None = None, status: str | None = None,
                source_id: int | None = None, company: str | None = None, q: str | None = None) -> DataFrame:
    """Listing predicates; ``%`` and ``_`` in texts act as wildcards."""
    if modality is not None and modality not in MODALITIES:
        raise ValueError(f"unknown modality {modality!r}")
    if region is not None:
        jobs = jobs.filter(F.col("region") == region.lower())
    if modality is not None:
        jobs = jobs.filter(F.col("modality") == modality)
    if status is not None:
        jobs = jobs.filter(F.col("status") == status.lower())
    if source_id is not None:
        jobs = jobs.filter(F.col("source_id") == source_id)
    if company is not None:
        jobs = jobs.filter(F.col("company").ilike(f"%{company}%"))
    if q is not None:
        like = [F.col(c).ilike(f"%{q}%") for c in ("title", "description", "company")]
        jobs = jobs.filter(like[0] | like[1] | like[2])
    return jobs


def scored_jobs(jobs: DataFrame, evaluations: DataFrame, profile_id: int | None = None, min_score: float | None = None) -> DataFrame:
    """``jobs`` with their best score; unscored ones stay unless ``min_score`` is given."""
    if profile_id is not None:
        evaluations = evaluations.filter(F.col("profile_id") == profile_id)
    if min_score is not None:
        if not 0 <= min_score <= 100:
            raise ValueError("min_score must be between 0 and 100")
        evaluations = evaluations.filter(F.col("score") >= min_score)
    best = evaluations.groupBy("job_id").agg(F.max("score").alias("score"))
    return jobs.join(best, "job_id", "left" if min_score is None else "inner")


def page_of(df: DataFrame, sort: str = "detected_at", direction: str = "desc", page: int = 1, size: int = 20, key: str = "job_id") -> DataFrame:
    """A page in a total order; null is the smallest value."""
    if sort not in SORTS or direction not in ("asc", "desc"):
        raise ValueError(f"unknown order {sort} {direction}")
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size is 1 to 100")
    c = F.col(sort).desc_nulls_last() if direction == "desc" else F.col(sort).asc_nulls_first()
    return df.orderBy(c, key).offset((page - 1) * size).limit(size)


def totals(df: DataFrame, size: int = 20) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def list_jobs(jobs: DataFrame, evaluations: DataFrame, profile_id: int | None = None, min_score: float | None = None,
              sort: str = "detected_at", direction: str = "desc", page: int = 1, size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, totals) of the filtered, scored postings."""
    found = scored_jobs(filter_jobs(jobs, **filters), evaluations, profile_id, min_score)
    return page_of(found, sort, direction, page, size), totals(found, size)


def latest_evaluation(evaluations: DataFrame) -> DataFrame:
    """The newest evaluation of each posting and profile."""
    newest = Window.partitionBy("job_id", "profile_id").orderBy(F.desc("evaluated_at"), F.desc("evaluation_id"))
    return evaluations.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def job_details(jobs: DataFrame, evaluations: DataFrame, most: int | None = None) -> DataFrame:
    """Every posting with its latest score and all evaluations, newest first, or the ``most`` newest ones.

    All of them come together in a row; a limit is applied before, where the evaluations are read.
    """
    entry = F.struct("evaluated_at", "evaluation_id", "profile_id", "score")
    if most is not None:
        newest = Window.partitionBy("job_id").orderBy(F.desc("evaluated_at"), F.desc("evaluation_id"))
        evaluations = evaluations.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most)
    history = evaluations.groupBy("job_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("history"))
    joined = jobs.join(history, "job_id", "left")
    return joined.withColumn("latest_score", F.get("history", F.lit(0))["score"])


def metrics(jobs: DataFrame, sources: DataFrame, executions: DataFrame) -> DataFrame:
    """One row of counters."""
    j = jobs.agg(F.count("*").alias("jobs_total"), F.count_if(F.col("status") == "active").alias("jobs_active"))
    s = sources.agg(F.count("*").alias("sources_total"), F.count_if("enabled").alias("sources_enabled"))
    e = executions.agg(F.count("*").alias("executions_total"), F.count_if(F.col("status") == "running").alias("executions_running"))
    return j.crossJoin(s).crossJoin(e)  # three single rows


def list_executions(executions: DataFrame, status: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """Executions, newest first."""
    if status is not None:
        executions = executions.filter(F.col("status") == status)
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size is 1 to 100")
    return executions.orderBy(F.desc("started_at"), F.desc("execution_id")).offset((page - 1) * size).limit(size)


def execution_of_run(executions: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """The execution with the immutable ``run_id``, its source runs nested; no row if there is none."""
    return executions_with_runs(executions.filter(F.col("run_uuid") == run_id), runs)


def executions_with_runs(executions: DataFrame, runs: DataFrame, most: int | None = None) -> DataFrame:
    """Executions with their source runs nested, in order of id, or the first ``most`` of each."""
    fields = [c for c in runs.columns if c not in ("execution_id", "run_id")]
    if most is not None:
        first = Window.partitionBy("execution_id").orderBy("run_id")
        runs = runs.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")
    nested = runs.groupBy("execution_id").agg(F.array_sort(F.collect_list(F.struct("run_id", *fields))).alias("runs"))
    return executions.join(nested, "execution_id", "left")


def regional_views(jobs: DataFrame) -> dict[str, DataFrame]:
    """One filtered view per region."""
    from jobloom.functions.fields import REGIONS

    return {region: jobs.filter(F.col("region") == region) for region in REGIONS}


LIST_FIELDS = (
    "job_id", "title", "company", "location", "region", "modality", "status", "description_url", "application_url",
    "published_at", "detected_at", "score",
)
DETAIL_FIELDS = ("description", "canonical_url", "salary_min", "salary_max", "salary_currency", "latest_score", "history")


def _projected(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The named columns; those that are missing are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])


def job_list_rows(scored: DataFrame) -> DataFrame:
    return _projected(scored, LIST_FIELDS)


def job_detail_rows(details: DataFrame) -> DataFrame:
    return _projected(details, (*LIST_FIELDS, *DETAIL_FIELDS))


def default_profile(profiles: DataFrame) -> DataFrame:
    """The profile with the lowest id."""
    return profiles.orderBy("profile_id").limit(1)


def _text(c: str, default: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c)


def safe_job(most: int = 12_000) -> Column:
    """The part of ``safe_payload`` that all pairs of a posting share: JSON of its named fields, the description cut."""
    description = F.left(F.coalesce("description", F.lit("")), F.lit(most)).alias("description")
    return F.to_json(F.struct(_text("title"), _text("company"), description, _text("location"), _text("region"), _text("modality", "unknown")))


def safe_payload(pairs: DataFrame, most: int = 12_000) -> DataFrame:
    """``job_id, profile_id, payload``: JSON of the named fields only, the description cut; no resume text.

    Reads the columns of scored pairs; experience entries keep what they state as numbers. A column ``safe_job``, made
    before postings were paired, saves writing the same text for each of their profiles.
    """
    def listed(c: str):
        return F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)

    entries = F.transform("experience", lambda e: F.struct(e["years"].alias("years"), e["years_experience"].alias("years_experience"), e["duration_years"].alias("duration_years")))
    preferences = F.struct(listed("locations"), listed("modalities"), _text("seniority")).alias("preferences")
    profile = F.struct(listed("skills"), entries.alias("experience"), listed("languages"), preferences)
    job = F.col("safe_job") if "safe_job" in pairs.columns else safe_job(most)
    payload = F.concat(F.lit('{"profile":'), F.to_json(profile), F.lit(',"job":'), job, F.lit("}"))
    return pairs.select("job_id", "profile_id", payload.alias("payload"))
