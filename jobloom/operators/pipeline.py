"""Ingestion, scoring and the full run, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.links import canonicalize_url, fingerprint
from jobloom.operators import identity, listing, reconcile, runs, scoring
from jobloom.sources import tables
from jobloom.sources.feeds import paged, read_feeds
from jobloom.sources.scratch import materialize

FIELDS = (
    "title", "company", "description", "description_url", "application_url", "canonical_url", "location", "region",
    "modality", "salary_min", "salary_max", "salary_currency", "salary_period", "published_at",
)


def _order(seq: Column, kind: str) -> Column:
    """Stored sequence numbers as text that sorts like them and begins with a run; what has none is of run 0.

    What has a run keeps its text, so that the first sighting of a posting is called the same after every run.
    """
    text = seq.cast("string")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.concat(F.lit(f"{0:012d}|"), F.lpad(text, 20, "0"))
    return F.when(text.rlike(r"^[0-9]{12}\|"), text).otherwise(F.concat(F.lit(f"{0:012d}|"), text))


def place(run: int, source: Column, page: Column, item_idx: Column) -> Column:
    """The order of sightings, by run, source, page (of ``feeds.paged``) and position, as a text that needs no global numbering."""
    return F.concat_ws("|", F.lit(f"{run:012d}"), source, page, F.lpad(item_idx.cast("string"), 12, "0"))


def run_ingest(raw: DataFrame, stored: DataFrame | None = None, per_source_cap: int | None = None) -> dict[str, DataFrame]:
    """Postings, snapshots, quarantine and source results of ``raw(source, base_url, default_company, payload)``.

    Card pages come in a column ``html``; where a source has several payloads, a number ``page`` orders them. ``stored`` are earlier sightings (``FIELDS`` with ``seq`` and ``source``,
    and ``metadata`` if they have it); new ones are a run of their own after them, so ingesting the same feed again
    changes no posting, and ``identity``, the first sighting, stays what it was. ``sightings`` of the result are the
    next run's ``stored``.
    """
    good, bad = read_feeds(paged(raw))
    at = F.struct("page", "item_idx")
    if per_source_cap is not None:
        good = runs.cap_per_source(good, per_source_cap, order=at)
    run = 1
    if stored is not None:
        held = F.col("metadata") if "metadata" in stored.columns else F.lit(None).cast("map<string,string>")
        stored = stored.select("source", *FIELDS, held.alias("metadata"), _order(F.col("seq"), dict(stored.dtypes)["seq"]).alias("seq"))
        run += stored.agg(F.max(F.left("seq", F.lit(12)).cast("long"))).first()[0] or 0
    sightings = good.select("source", *FIELDS, "metadata", place(run, F.col("source"), F.col("page"), F.col("item_idx")).alias("seq"))
    if stored is not None:
        sightings = stored.unionByName(sightings)
    keyed = sightings.withColumns({
        "canonical_url": F.coalesce(canonicalize_url(F.col("canonical_url")), F.col("canonical_url")),
        "fingerprint": fingerprint(F.col("title"), F.col("company"), F.col("location")),
    })
    found = materialize(identity.identity_components(materialize(keyed, "keyed")), "sightings")
    items = good.select("source", at.alias("item_idx"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("source", at.alias("item_idx"), F.lit(False).alias("ok"), "error")
    )
    metadata = identity.merge_metadata(found, "metadata")
    return {
        "postings": identity.merge_postings(found, [*FIELDS, "fingerprint"]).join(metadata, "identity", "left"),
        "sightings": found.drop("identity", "fingerprint"),
        "snapshots": identity.snapshots(found),
        "quarantine": bad.select("source", "page", "item_idx", "error"),
        "source_runs": runs.source_runs(items, raw.select("source").distinct()),
    }


def scorable(jobs: DataFrame) -> DataFrame:
    """Add what scoring reads of a posting's ``metadata``: skills, constraints, authorization, years and seniority.

    Lists are JSON arrays or a single text; what the provider does not state is empty.
    """
    def text(key: str) -> Column:
        return F.try_element_at("metadata", F.lit(key))

    def listed(key: str) -> Column:
        given = F.nullif(F.btrim(text(key)), F.lit(""))
        many = F.try_variant_get(F.try_parse_json(given), "$", "array<string>")
        return F.coalesce(many, F.when(given.isNotNull(), F.array(given)), F.array().cast("array<string>"))

    return jobs.withColumns({
        "required_skills": listed("required_skills"), "desirable_skills": listed("desirable_skills"),
        "constraints": listed("constraints"), "job_authorization": listed("work_authorization"),
        "required_years": text("required_years").try_cast("double"), "job_seniority": text("seniority"),
    })


def run_scoring(postings: DataFrame, profiles: DataFrame, preferences: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """New evaluations: pairs without an evaluation of the same inputs, scored.

    ``earlier(evaluation_id, job_id, profile_id, evaluated_at, fingerprint)`` are kept evaluations. Postings and
    profiles are hashed once each, and only pairs of which a side has changed are made (``scoring.due_pairs``).
    """
    latest = None if earlier is None else listing.latest_evaluation(earlier)
    return scoring.score(scoring.due_pairs(postings, profiles, preferences, latest))


def mirrored(jobs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Postings and their evaluations as rows of the mirror, with all of its properties."""
    listed = F.try_variant_get(F.try_parse_json(F.try_element_at("metadata", F.lit("requirements"))), "$", "array<string>")
    scored = evaluations.select(
        "job_id", "profile_id", "score", "matches", "gaps", "recommendations", scoring.explanation(F.col("breakdown")).alias("explanation")
    )
    rows = jobs.withColumns({
        "requirements": listed, "salary_period": F.coalesce("salary_period", F.try_element_at("metadata", F.lit("salary_period"))),
    })
    return reconcile.to_mirror_rows(rows.join(scored, "job_id", "left"))


def run_all(raw: DataFrame, profiles: DataFrame, preferences: DataFrame, seen: DataFrame, sources: DataFrame,
            stored: DataFrame | None = None, root: str | None = None, before: DataFrame | None = None,
            earlier: DataFrame | None = None, reactivate: bool = False) -> dict[str, DataFrame]:
    """Ingest, mark missing postings, score, project the mirror; with the run's summary.

    ``sources(source, source_id)`` numbers the sources; ``seen(source, url)`` are the links of this run, and active
    postings of its sources that are not among them become inactive. ``stored``, ``before`` and ``earlier`` are the
    ``sightings``, ``jobs`` and ``all_evaluations`` of the run before: a posting keeps its id, the time it was detected
    and its status, so one that is found again stays inactive unless ``reactivate``; and only pairs of a posting and a
    profile of which one has changed are scored again. With ``root`` the run log is appended to its tables.
    """
    out = run_ingest(raw, stored)
    now = F.current_timestamp()
    found = out["sightings"].groupBy("canonical_url").agg(F.min_by("source", "seq").alias("source"), F.max(F.left("seq", F.lit(12))).alias("seen_run"))
    newest = out["sightings"].agg(F.max(F.left("seq", F.lit(12)))).first()[0]
    jobs = out["postings"].withColumn("job_id", F.xxhash64("identity"))
    jobs = jobs.join(found.join(sources, "source", "left"), "canonical_url", "left")
    again = F.col("seen_run") == F.lit(newest)
    if before is None:
        jobs = jobs.withColumns({"status": F.lit("active"), "detected_at": now, "checked_at": now})
    else:
        held = before.select("job_id", F.col("status").alias("_status"), F.col("detected_at").alias("_detected"), F.col("checked_at").alias("_checked"))
        back = F.when(again, F.lit("active")) if reactivate else F.lit(None).cast("string")
        jobs = jobs.join(held, "job_id", "left").withColumns({
            "status": F.coalesce(back, F.col("_status"), F.lit("active")), "detected_at": F.coalesce("_detected", now),
            "checked_at": F.coalesce(F.when(again, now), F.col("_checked"), now),
        }).drop("_status", "_detected", "_checked")
    jobs = jobs.drop("seen_run")
    out["jobs"] = materialize(identity.mark_missing_of_sources(jobs, seen), "jobs")
    made = run_scoring(scorable(out["jobs"]), profiles, preferences, earlier)
    made = made.withColumns({"evaluation_id": F.xxhash64("job_id", "profile_id", "fingerprint"), "evaluated_at": now})
    out["evaluations"] = materialize(made, "evaluations")
    held = ["evaluation_id", "job_id", "profile_id", "evaluated_at", "fingerprint", "score", "breakdown", "matches", "gaps", "recommendations"]
    every = out["evaluations"].select(*held)
    out["all_evaluations"] = every if earlier is None else every.unionByName(earlier.select(*held))
    latest = out["all_evaluations"] if earlier is None else listing.latest_evaluation(out["all_evaluations"])
    out["mirror"] = mirrored(out["jobs"], latest)
    results = out["source_runs"].select(
        F.lit(1).alias("execution_id"), "source", "jobs_found", "status", F.col("jobs_found").alias("scored"), F.col("errors").alias("issues")
    )
    out["summary"] = materialize(runs.execution_summary(results), "summary")
    if root is not None:
        tables.write_run_log(root, out["summary"], results)
    return out
