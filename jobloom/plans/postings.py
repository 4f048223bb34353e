"""Queries of identity, history, listing, scoring, runs and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.fields import classify_modality, classify_region
from jobloom.functions.links import canonicalize_url, fingerprint
from jobloom.operators import history, identity, listing, policy, reconcile, runs, scoring
from jobloom.plans import views as v
from jobloom.plans.catalog import query
from jobloom.plans.normalization import MODALITY, REGION


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.ident(spark, sf_dir)
    return rows.withColumns({
        "canonical_url": canonicalize_url(F.col("url")),
        "fingerprint": fingerprint(F.col("title"), F.col("company"), F.lit(None).cast("string")),
    })


# Chains stay within blocks of eight rows, so four joins reach every row of a component.
_COMPONENTS = f"""WITH RECURSIVE {v.IDENT}, reach(seq, other) AS (
  SELECT seq, seq FROM ident
  UNION
  SELECT r.seq, b.seq FROM reach r JOIN ident a ON a.seq = r.other
  JOIN ident b ON b.company = a.company AND (b.canonical_url = a.canonical_url OR b.title = a.title)),
comp AS (SELECT seq, min(other) AS identity FROM reach GROUP BY 1)"""


@query(f"{_COMPONENTS} SELECT seq, identity FROM comp")
def identity_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identity_components(_sightings(spark, sf_dir)).select("seq", "identity")


def _best(c: str) -> str:
    useful = f"{c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ('', 'unknown', 'other')"
    return f"coalesce(arg_max({c}, i.seq) FILTER (WHERE {useful}), arg_max_null({c}, i.seq)) AS {c}"


@query(f"""{_COMPONENTS} SELECT identity, {_best("title")}, {_best("modality")}, {_best("description")}, {_best("salary_min")},
  arg_min(source_id, i.seq) FILTER (WHERE source_id IS NOT NULL) AS source_id, count(*) AS sightings
  FROM ident i JOIN comp c ON i.seq = c.seq GROUP BY identity""")
def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.identity_components(_sightings(spark, sf_dir))
    return identity.merge_postings(found, ["title", "modality", "description", "salary_min"])


@query(f"""WITH {v.IDENT}, old AS (SELECT * FROM ident WHERE seq % 3 = 0), new AS (SELECT * FROM ident WHERE seq % 3 <> 0),
u AS (SELECT canonical_url, min(seq) AS job_id FROM old GROUP BY 1), f AS (SELECT title, company, min(seq) AS job_id FROM old GROUP BY 1, 2)
SELECT n.seq, coalesce(u.job_id, f.job_id) AS job_id, coalesce(u.job_id <> f.job_id, FALSE) AS identity_conflict
FROM new n LEFT JOIN u ON n.canonical_url = u.canonical_url LEFT JOIN f ON n.title = f.title AND n.company = f.company""")
def matched_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the sightings looked up among the others, by URL and then by fingerprint."""
    rows = _sightings(spark, sf_dir)
    old = rows.filter("seq % 3 = 0")
    by_url = old.groupBy("canonical_url").agg(F.min("seq").alias("_u"))
    by_print = old.groupBy("fingerprint").agg(F.min("seq").alias("_f"))
    known = by_url.select(F.col("_u").alias("job_id"), "canonical_url", F.lit(None).cast("string").alias("fingerprint")).unionByName(
        by_print.select(F.col("_f").alias("job_id"), F.lit(None).cast("string").alias("canonical_url"), "fingerprint")
    )
    new = rows.filter("seq % 3 <> 0")
    return identity.resolve_identity(new, known).select("seq", "job_id", "identity_conflict")


@query(f"""WITH {v.VERSIONS}, f AS (SELECT identity, seq,
  coalesce(last_value(description IGNORE NULLS) OVER w, '') AS d, coalesce(last_value(description_url IGNORE NULLS) OVER w, '') AS u
  FROM versions WINDOW w AS (PARTITION BY identity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, lag(d) OVER w AS pd, lag(u) OVER w AS pu FROM f WINDOW w AS (PARTITION BY identity ORDER BY seq))
SELECT identity, min(seq) AS replaced_at, nullif(pd, '') AS description, nullif(pu, '') AS description_url FROM g
WHERE pd IS NOT NULL AND (pd <> d OR pu <> u) GROUP BY identity, pd, pu""")
def content_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.snapshots(v.versions(spark, sf_dir)).select("identity", "replaced_at", "description", "description_url")


@query(f"""WITH {v.JOBS} SELECT job_id, CASE WHEN status = 'active' AND source_id = 2 AND job_id % 4 <> 0 THEN 'inactive' ELSE status END AS status,
  status = 'active' AND source_id = 2 AND job_id % 4 <> 0 AS marked FROM jobs""")
def missing_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = v.jobs(spark, sf_dir)
    url = F.concat(F.lit("https://jobs.example/"), F.col("job_id").cast("string"))
    seen = jobs.filter("job_id % 4 = 0").select(F.concat(url, F.lit("?utm_medium=email")).alias("url"))
    marked = identity.mark_missing(jobs.withColumn("canonical_url", url), seen, 2)
    return marked.select("job_id", "status", "marked")


@query("""SELECT user_id AS job_id, min(event_id) AS position, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def deduplicated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "value")
    return identity.dedup_run(e).select("job_id", "position", "seq", "value")


@query(f"""WITH {v.EVALUATIONS} SELECT evaluation_id, job_id, profile_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY job_id, profile_id ORDER BY evaluated_at DESC, evaluation_id DESC) AS n FROM evaluations) WHERE n = 1""")
def latest_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.latest_evaluation(v.evaluations(spark, sf_dir)).select("evaluation_id", "job_id", "profile_id", "score")


_LISTED = f"""WITH {v.JOBS}, {v.EVALUATIONS}, best AS (SELECT job_id, max(score) AS score FROM evaluations WHERE profile_id = 1 GROUP BY 1),
found AS (SELECT j.*, b.score FROM jobs j LEFT JOIN best b ON j.job_id = b.job_id WHERE region = 'cdmx' AND (title ILIKE '%o%' OR description ILIKE '%o%' OR company ILIKE '%o%'))"""


@query(f"{_LISTED} SELECT job_id, title, company, region, score FROM found ORDER BY score DESC NULLS LAST, job_id LIMIT 20 OFFSET 20")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = listing.list_jobs(v.jobs(spark, sf_dir), v.evaluations(spark, sf_dir), profile_id=1, sort="score", page=2, region="CDMX", q="o")
    return page.select("job_id", "title", "company", "region", "score")


@query(f"{_LISTED} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM found")
def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, totals = listing.list_jobs(v.jobs(spark, sf_dir), v.evaluations(spark, sf_dir), profile_id=1, sort="score", region="CDMX", q="o")
    return totals


@query(f"""WITH {v.JOBS}, {v.EVALUATIONS} SELECT j.job_id, max(e.score) AS score FROM jobs j JOIN evaluations e ON j.job_id = e.job_id
  WHERE e.score >= 20 AND j.status = 'active' AND j.modality = 'remote' GROUP BY 1""")
def scored_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = listing.filter_jobs(v.jobs(spark, sf_dir), status="ACTIVE", modality="remote")
    return listing.scored_jobs(jobs, v.evaluations(spark, sf_dir), min_score=20).select("job_id", "score")


@query(f"""WITH {v.JOBS}, {v.EVALUATIONS} SELECT j.job_id, arg_max(e.score, (e.evaluated_at, e.evaluation_id)) AS latest_score, count(e.job_id) AS evaluations,
  string_agg(CAST(e.evaluation_id AS VARCHAR), ',' ORDER BY e.evaluated_at DESC, e.evaluation_id DESC) AS history
  FROM jobs j LEFT JOIN evaluations e ON j.job_id = e.job_id GROUP BY 1""")
def posting_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listing.job_details(v.jobs(spark, sf_dir), v.evaluations(spark, sf_dir))
    ids = F.transform("history", lambda h: h["evaluation_id"].cast("string"))
    return d.select("job_id", "latest_score", F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("evaluations"), F.array_join(ids, ",").alias("history"))


@query(f"""WITH {v.JOBS} SELECT * FROM (SELECT count(*) AS jobs_total, count(*) FILTER (WHERE status = 'active') AS jobs_active FROM jobs),
  (SELECT count(*) AS sources_total, count(*) FILTER (WHERE s_acctbal > 0) AS sources_enabled FROM supplier),
  (SELECT count(*) AS executions_total, count(*) FILTER (WHERE o_orderstatus = 'P') AS executions_running FROM orders)""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = v.read(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("enabled"))
    status = F.when(F.col("o_orderstatus") == "P", "running").otherwise("success")
    return listing.metrics(v.jobs(spark, sf_dir), sources, v.read(spark, sf_dir, "orders").select(status.alias("status")))


@query("""SELECT o_orderkey AS execution_id, o_orderdate AS started_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def newest_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    return listing.list_executions(o, status="F", size=50).drop("status")


@query(f"""WITH {v.RUNS} SELECT o_orderkey AS execution_id, count(run_id) AS runs, string_agg(run_id || ':' || jobs_found, ',' ORDER BY run_id, jobs_found) AS detail
  FROM orders LEFT JOIN runs ON o_orderkey = execution_id GROUP BY 1""")
def executions_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"))
    nested = listing.executions_with_runs(o, v.runs(spark, sf_dir).select("execution_id", "run_id", "jobs_found"))
    detail = F.array_join(F.transform("runs", lambda r: F.concat(r["run_id"], F.lit(":"), r["jobs_found"].cast("string"))), ",")
    return nested.select("execution_id", F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("runs"), detail.alias("detail"))


_GRADED = """SELECT execution_id, CAST(sum(jobs_found) AS BIGINT) AS jobs_found, CAST(sum(scored) AS BIGINT) AS scored,
  CAST(sum(issues) AS BIGINT) AS issues, count(*) FILTER (WHERE status <> 'success') AS bad_sources, count(*) AS sources FROM runs GROUP BY 1"""


@query(f"""WITH {v.RUNS}, g AS ({_GRADED}) SELECT execution_id, jobs_found, issues,
  CASE WHEN issues > 0 AND scored = 0 THEN 'failed' WHEN issues > 0 THEN 'partial' ELSE 'success' END AS status FROM g""")
def execution_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.execution_summary(v.runs(spark, sf_dir), "pipeline").select("execution_id", "jobs_found", "issues", "status")


@query(f"""WITH {v.RUNS}, g AS ({_GRADED}) SELECT execution_id, jobs_found, issues,
  CASE WHEN jobs_found = 0 THEN 'failed' WHEN bad_sources > 0 OR issues > 0 THEN 'partial' ELSE 'success' END AS status FROM g""")
def refresh_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.execution_summary(v.runs(spark, sf_dir), "refresh").select("execution_id", "jobs_found", "issues", "status")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS jobs_found, count(*) FILTER (WHERE event_type = 'error') AS errors,
  left(string_agg('bad item ' || event_id, '; ' ORDER BY event_id) FILTER (WHERE event_type = 'error'), 2000) AS digest FROM events GROUP BY 1),
s AS (SELECT DISTINCT user_id FROM events UNION SELECT -1 - n_nationkey FROM nation)
SELECT CAST(s.user_id AS VARCHAR) AS source, coalesce(jobs_found, 0) AS jobs_found, coalesce(errors, 0) AS errors,
  CASE WHEN coalesce(jobs_found, 0) = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'success' END AS status,
  coalesce(digest, CASE WHEN coalesce(jobs_found, 0) = 0 THEN 'No jobs found for ' || s.user_id END) AS message
FROM s LEFT JOIN c ON s.user_id = c.user_id""")
def source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.read(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    source = F.col("user_id").cast("string").alias("source")
    items = e.select(
        source, F.col("event_id").alias("item_idx"), (~bad).alias("ok"), F.when(bad, F.concat(F.lit("bad item "), F.col("event_id").cast("string"))).alias("error")
    )
    idle = v.read(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("string").alias("source"))  # sources without items
    return runs.source_runs(items, e.select(source).distinct().unionByName(idle))


@query("SELECT count(*) FILTER (WHERE l_returnflag <> 'R') AS synced, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem")
def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sync_counts(v.read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") != "R").alias("ok")))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, pages = v.mirror(spark, sf_dir)
    return reconcile.reconcile(local, pages, ["title", "company"])


@query(f"WITH {v.MIRROR} SELECT * FROM differences")
def mirror_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir).withColumn("fields", F.array_join(F.transform("fields", lambda d: d["field"]), ","))


@query(f"""WITH {v.MIRROR} SELECT (SELECT count(*) FROM pages_) AS page_count, count(*) FILTER (WHERE retryable) AS retryable_count,
  count(*) FILTER (WHERE kind = 'orphan') AS orphan_count, CASE WHEN count(*) > 0 THEN 'drift' ELSE 'clean' END AS state FROM differences""")
def mirror_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile_summary(_differences(spark, sf_dir), v.mirror(spark, sf_dir)[1])


@query(f"""WITH {v.MIRROR} SELECT kind, job_id, page_id, CASE WHEN NOT retryable THEN 'skipped' WHEN job_id % 14 = 0 THEN 'failed' WHEN job_id % 3 = 0 THEN 'failed' ELSE 'repaired' END AS result,
  CASE WHEN NOT retryable THEN NULL WHEN job_id % 14 = 0 THEN 'local_job_not_found' WHEN job_id % 3 = 0 THEN 'attempt_failed' END AS error FROM differences""")
def mirror_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, _ = v.mirror(spark, sf_dir)
    outcomes = local.select("job_id", (F.col("job_id") % 3 != 0).alias("ok"))
    plan = reconcile.repair_plan(_differences(spark, sf_dir), local.filter("job_id % 14 <> 0"), outcomes)
    return plan.select("kind", "job_id", "page_id", "result", "error")


@query(f"""WITH {v.JOBS} SELECT title AS "Title", company AS "Company", region AS "Region", modality AS "Modality", CASE WHEN job_id % 3 > 0 THEN description END AS "Location",
  CASE WHEN job_id % 2 = 0 THEN title || ', ' || company END AS "Requirements", CASE WHEN job_id % 5 > 0 THEN CAST(detected_at AS DOUBLE) END AS "Salary min",
  CAST(detected_at * 2 AS DOUBLE) AS "Salary max", CASE WHEN job_id % 4 > 0 THEN 'MXN' END AS "Salary currency", 'month' AS "Salary period", 's' || source_id AS "Source",
  'https://jobs.example/' || job_id AS "Description URL", CASE WHEN job_id % 2 = 0 THEN left(repeat('https://jobs.example/a/', 100) || job_id, 2000) END AS "Application URL",
  'https://jobs.example/' || job_id AS "Canonical URL", CAST(DATE '2026-01-01' + CAST(detected_at AS INTEGER) AS VARCHAR) AS "Published", '2026-03-01' AS "Detected", '2026-03-02' AS "Checked",
  CAST(job_id % 100 AS DOUBLE) AS "Compatibility score", left(repeat(title, 300), 2000) AS "Score explanation", title AS "Matches", CAST(NULL AS VARCHAR) AS "Gaps",
  'Close gap: ' || company || ', Close gap: ' || title AS "Recommendations", status AS "Status", CAST(job_id AS VARCHAR) AS "Local job ID", 'fp' || job_id AS "Fingerprint" FROM jobs""")
def mirror_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All properties of the mirror, some of them blank or too long."""
    k, size, none = F.col("job_id"), F.col("detected_at"), F.array().cast("array<string>")
    link = F.concat(F.lit("https://jobs.example/"), k.cast("string"))
    jobs = v.jobs(spark, sf_dir).withColumns({
        "location": F.when(k % 3 > 0, F.col("description")).otherwise(""), "requirements": F.when(k % 2 == 0, F.array("title", "company")).otherwise(none),
        "salary_min": F.when(k % 5 > 0, size), "salary_max": size * 2, "salary_currency": F.when(k % 4 > 0, "MXN").otherwise(""), "salary_period": F.lit("month"),
        "source": F.concat(F.lit("s"), F.col("source_id").cast("string")), "description_url": link, "canonical_url": link,
        "application_url": F.when(k % 2 == 0, F.concat(F.repeat(F.lit("https://jobs.example/a/"), F.lit(100)), k.cast("string"))).otherwise(""),
        "published_at": F.date_add(F.lit("2026-01-01").cast("date"), size.cast("int")), "detected_at": F.lit("2026-03-01").cast("date"), "checked_at": F.lit("2026-03-02").cast("date"),
        "score": k % 100, "explanation": F.repeat("title", F.lit(300)), "matches": F.array("title"), "gaps": none,
        "recommendations": F.transform(F.array("company", "title"), lambda g: F.concat(F.lit("Close gap: "), g)), "fingerprint": F.concat(F.lit("fp"), k.cast("string")),
    })
    return reconcile.to_mirror_rows(jobs)


@query("""WITH x AS (SELECT user_id AS profile_id, event_id AS seq, CASE WHEN event_type <> 'view' THEN event_type END AS skills,
  CASE WHEN event_id % 2 = 0 THEN CAST(floor(value / 40) AS VARCHAR) END AS languages FROM events),
y AS (SELECT *, last_value(skills IGNORE NULLS) OVER w AS ps, last_value(languages IGNORE NULLS) OVER w AS pl FROM x
  WINDOW w AS (PARTITION BY profile_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (skills IS NOT NULL AND skills IS DISTINCT FROM ps) AS cs, (languages IS NOT NULL AND languages IS DISTINCT FROM pl) AS cl FROM y)
SELECT profile_id, seq, concat_ws(',', CASE WHEN cl THEN 'languages' END, CASE WHEN cs THEN 'skills' END) AS changed, cs OR cl AS needs_reevaluation,
  CAST(1 + sum(CASE WHEN cs OR cl THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY seq) AS BIGINT) AS version FROM z""")
def profile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.read(spark, sf_dir, "events")
    patches = e.select(
        F.col("user_id").alias("profile_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("skills"),
        F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") / 40).cast("string")).alias("languages"),
    )
    h = history.profile_versions(patches, ["skills", "languages"])
    return h.select("profile_id", "seq", F.array_join("changed_dimensions", ",").alias("changed"), "needs_reevaluation", "version")


@query("""SELECT user_id AS profile_id, event_id AS seq, lead(event_id) OVER w IS NULL AS is_current, CAST(row_number() OVER w + 1 AS INTEGER) AS version
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def preference_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.read(spark, sf_dir, "events").select(F.col("user_id").alias("profile_id"), F.col("event_id").alias("seq"))
    return history.preference_history(e)


@query("""SELECT c_custkey AS profile_id, c_nationkey AS version, CASE WHEN c_custkey % 2 = 0 THEN FALSE ELSE TRUE END AS needs_reevaluation FROM customer""")
def cleared_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.read(spark, sf_dir, "customer")
    profiles = c.select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("version"), F.lit(True).alias("needs_reevaluation"))
    done = c.select(F.col("c_custkey").alias("profile_id"), (F.col("c_nationkey") - F.col("c_custkey") % 2).cast("int").alias("evaluated_version"))
    return history.clear_reevaluation(profiles, done)


@query("""SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS name,
  CASE WHEN s_suppkey % 6 = 0 THEN 0.0 ELSE s_acctbal END AS balance FROM supplier
  UNION ALL SELECT s_suppkey + 1000000, upper(s_name), 0.0 FROM supplier WHERE s_suppkey % 10 = 0""")
def upserted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.read(spark, sf_dir, "supplier")
    old = s.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    newer = old.filter("source_id % 3 = 0").select("source_id", F.upper("name").alias("name"), F.when(F.col("source_id") % 6 == 0, 0.0).alias("balance"), F.lit(2).alias("seq"))
    stale = old.filter("source_id % 3 = 0").select("source_id", F.lit("old").alias("name"), F.lit(-1.0).alias("balance"), F.lit(1).alias("seq"))
    added = old.filter("source_id % 10 = 0").select((F.col("source_id") + 1_000_000).alias("source_id"), F.upper("name").alias("name"), F.lit(0.0).alias("balance"), F.lit(1).alias("seq"))
    return history.upsert_by_key(old, newer.unionByName(stale).unionByName(added), ["source_id"], "seq", merge=True)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 8 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def patched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    patches = c.filter("c_custkey % 4 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 8 == 0, 0.0).alias("c_acctbal"))
    return history.apply_patches(c, patches, "c_custkey")


@query(f"WITH {v.JOBS} SELECT job_id, CASE WHEN source_id NOT IN (1, 4) THEN source_id END AS source_id FROM jobs")
def orphaned_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = v.jobs(spark, sf_dir)
    sources = jobs.select("source_id").distinct()
    gone = sources.filter("source_id in (1, 4)")
    return history.delete_sources(sources, jobs, jobs.select("job_id", "source_id"), gone)[1].select("job_id", "source_id")


@query("SELECT l_suppkey AS source_id, count(*) AS runs FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1")
def remaining_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as runs of suppliers; those of deleted suppliers go with them."""
    s = v.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_acctbal")
    lines = v.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), "l_orderkey")
    _, _, left = history.delete_sources(s, v.jobs(spark, sf_dir), lines, s.filter("s_acctbal < 0"))
    return left.groupBy("source_id").agg(F.count("*").alias("runs"))


@query(f"""WITH {v.EVALUATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY evaluated_at DESC, evaluation_id DESC) AS n FROM evaluations), {v.JOBS}
SELECT j.job_id, string_agg(CAST(evaluation_id AS VARCHAR), ',' ORDER BY n) AS newest, max(score) FILTER (WHERE n = 1) AS latest_score FROM jobs j LEFT JOIN r ON r.job_id = j.job_id AND n <= 3 GROUP BY 1""")
def newest_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with their three newest evaluations only, however many there are."""
    found = listing.job_details(v.jobs(spark, sf_dir), v.evaluations(spark, sf_dir), most=3)
    newest = F.array_join(F.transform("history", lambda e: e["evaluation_id"].cast("string")), ",")
    return found.select("job_id", newest.alias("newest"), "latest_score")


@query("SELECT s_name AS name, s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_name")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.sources.tables import enabled_sources as enabled

    s = v.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_suppkey", (F.col("s_acctbal") > 0).alias("enabled"))
    return enabled(s).drop("enabled")


@query(f"WITH {v.JOBS} SELECT region, count(*) AS postings FROM jobs GROUP BY 1")
def regional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [d.groupBy("region").agg(F.count("*").alias("postings")) for d in listing.regional_views(v.jobs(spark, sf_dir)).values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(r"""WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages),
r AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages), h AS (SELECT host, CASE WHEN length(host) % 5 = 0 THEN 404 WHEN length(host) % 5 = 1 THEN 403 WHEN length(host) % 5 = 2 THEN 503 ELSE 200 END AS status FROM r)
SELECT u.url, u.host, CASE WHEN status = 403 THEN 'denied' WHEN status = 503 THEN 'unverifiable' WHEN status = 404 THEN 'allowed'
  WHEN starts_with(p, '/en') THEN 'allowed' WHEN starts_with(p, '/') OR p = '' THEN 'denied' ELSE 'allowed' END AS verdict FROM u JOIN h ON u.host = h.host""")
def crawl_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = v.read(spark, sf_dir, "pages").select("url")
    hosts = urls.select(F.lower(F.regexp_extract("url", r"^https?://([^/?#]*)", 1)).alias("host")).distinct()
    rules = hosts.select("host", F.explode(F.array(F.struct(F.lit("/").alias("prefix"), F.lit(False).alias("allow")), F.struct(F.lit("/en").alias("prefix"), F.lit(True).alias("allow")))).alias("r")).select("host", "r.*")
    n = F.length("host") % 5
    status = F.when(n == 0, 404).when(n == 1, 403).when(n == 2, 503).otherwise(200)
    return policy.apply_crawl_policy(urls, rules, hosts.select("host", status.alias("status"))).select("url", "host", "verdict")


_CUT = r"'^https?://([^/?#]*)'"


@query(rf"""WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, {_CUT}, 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages),
a AS (SELECT *, page_id % 2 = 0 AS api FROM (SELECT page_id, url FROM pages)),
n AS (SELECT DISTINCT a.api, u.url, u.host, CASE WHEN u.p = '' THEN '/' ELSE u.p END AS path FROM a JOIN u ON a.url = u.url),
r AS (SELECT host, prefix, bool_and(k % 3 > 0) AS allow FROM (SELECT host, regexp_extract(path, '^(/[^/]*)', 1) AS prefix, length(path) AS k FROM n
  UNION ALL SELECT host, path, length(path) + 1 FROM n) GROUP BY 1, 2),
m AS (SELECT n.api, n.url, max((length(prefix), allow)) AS best FROM n JOIN r ON n.host = r.host AND starts_with(n.path, r.prefix) GROUP BY 1, 2)
SELECT CASE WHEN n.api THEN 'api.' || n.host ELSE n.host END AS host, n.path, n.host AS rules_of,
  CASE WHEN length(n.host) % 4 = 0 AND n.api THEN 'unverifiable' WHEN length(n.host) % 4 = 0 THEN 'denied' WHEN coalesce(best[2], TRUE) THEN 'allowed' ELSE 'denied' END AS verdict,
  count(*) AS urls FROM n LEFT JOIN m ON n.api = m.api AND n.url = m.url GROUP BY ALL""")
def borrowed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made of the pages' own paths, several a host; half of the pages are asked of an API host that answers 401 and borrows its public host's rules."""
    pages = v.read(spark, sf_dir, "pages")
    host, path = F.lower(F.regexp_extract("url", r"^https?://([^/?#]*)", 1)), F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    rows = pages.select("url", host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path"), (F.col("page_id") % 2 == 0).alias("api"))
    asked = rows.select(F.when(F.col("api"), F.regexp_replace("url", r"^(https?://)", "$1api.")).otherwise(F.col("url")).alias("url"))
    k = F.length("path")
    rules = rows.select("host", F.explode(F.array(
        F.struct(F.regexp_extract("path", "^(/[^/]*)", 1).alias("prefix"), k.alias("k")), F.struct(F.col("path").alias("prefix"), (k + 1).alias("k")),
    )).alias("r")).groupBy("host", F.col("r.prefix").alias("prefix")).agg(F.bool_and(F.col("r.k") % 3 > 0).alias("allow"))
    public = rows.select("host").distinct()
    api = F.concat(F.lit("api."), "host")
    hosts = public.select("host", F.when(F.length("host") % 4 == 0, 403).otherwise(200).alias("status")).unionByName(public.select(api.alias("host"), F.lit(401).alias("status")))
    lenders = public.select(api.alias("host"), F.lit(401).alias("status"), F.col("host").alias("lender"))
    found = policy.apply_crawl_policy(asked, rules, hosts, lenders)
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    found = found.select("host", F.when(path == "", "/").otherwise(path).alias("path"), "rules_of", "verdict")
    return found.groupBy("host", "path", "rules_of", "verdict").agg(F.count("*").alias("urls"))


_WORDS = r"[w FOR w IN string_split(trim(regexp_replace(lower(description), '[^\p{L}]+', ' ', 'g')), ' ') IF w <> '']"


def _stems(wanted) -> Column:
    """Beginnings of the words of a description whose length is wanted."""
    return F.array_distinct(F.transform(F.filter("_w", lambda w: wanted(F.length(w))), lambda w: F.left(w, F.lit(3))))


def _scoring_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings with skills from their words, and profiles with preferences made from nations."""
    d = v.doc_postings(spark, sf_dir)
    words = F.filter(F.split(F.btrim(F.regexp_replace(F.lower("description"), r"[^\p{L}]+", " ")), " "), lambda w: w != "")
    d = d.withColumn("_w", words)
    none = F.lit(None).cast("string")
    postings = d.select(
        "job_id", "location", classify_region(F.col("location")).alias("region"), classify_modality(F.col("mode_text")).alias("modality"),
        F.when(F.col("job_id") % 3 > 0, F.col("n_chars") * 12.0).alias("salary_max"),
        _stems(lambda n: n >= 14).alias("required_skills"), _stems(lambda n: n == 13).alias("desirable_skills"),
        F.when(F.col("job_id") % 9 == 0, F.array(F.lit("relocation"))).otherwise(F.array().cast("array<string>")).alias("constraints"),
        F.array("lang").alias("job_authorization"), (F.col("job_id") % 6).cast("double").alias("required_years"),
        F.when(F.col("job_id") % 2 == 0, F.lit("Senior")).otherwise(none).alias("job_seniority"),
    )
    n = v.read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    entry = F.struct(k.cast("double").alias("years"), F.lit(None).cast("double").alias("years_experience"), F.lit(None).cast("double").alias("duration_years"), F.lit("").alias("text"))
    profiles = n.select(
        k.alias("profile_id"), F.array(F.lit("The"), F.lit("con "), F.lit("ent"), F.lit("und")).alias("skills"), F.array(entry).alias("experience"),
        F.array(F.lit("English")).alias("languages"),
    )
    preferences = n.select(
        k.alias("profile_id"), F.lit(1).alias("preference_id"), F.lit(True).alias("is_current"),
        F.array(F.lit("english"), F.lit("spanish")).alias("preferred_languages"), F.when(k % 2 == 0, F.array(F.lit("CDMX"))).alias("locations"),
        F.when(k % 3 == 0, F.array(F.lit("remote"))).alias("modalities"), F.when(k % 4 == 0, F.array(F.lit("Relocation"))).alias("excluded_constraints"),
        F.array(F.lit("en"), F.lit("de")).alias("work_authorization"), F.lit("senior").alias("seniority"), F.lit(20000.0).alias("wanted_min"),
        (k == 6).alias("willing_to_relocate"), F.create_map(F.lit("skills"), F.lit(2.0), F.lit("salary"), F.when(k == 5, 0.0).otherwise(-1.0)).alias("weights"),
    )
    return postings, profiles, preferences


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pair(*_scoring_inputs(spark, sf_dir))


_SCORES = rf"""WITH {v.DOC_POSTINGS},
p AS (SELECT job_id, location, {REGION} AS region, {MODALITY} AS modality, CASE WHEN job_id % 3 > 0 THEN n_chars * 12.0 END AS salary_max,
  {_WORDS} AS w, job_id % 9 = 0 AS relocation, lang, job_id % 6 AS required_years, job_id % 2 = 0 AS senior FROM doc_postings),
q AS (SELECT *, list_distinct([left(a, 3) FOR a IN w IF length(a) >= 14]) AS req, list_distinct([left(a, 3) FOR a IN w IF length(a) = 13]) AS des,
  ['the', 'con', 'ent', 'und'] AS have FROM p),
x AS (SELECT q.*, n_nationkey AS k FROM q, nation),
d AS (SELECT *,
  CASE WHEN len(req) = 0 AND len(des) = 0 THEN 1.0 ELSE
    0.7 * CASE WHEN len(req) = 0 THEN 1.0 ELSE len(list_intersect(have, req)) / CAST(len(req) AS DOUBLE) END
    + 0.3 * CASE WHEN len(des) = 0 THEN 1.0 ELSE len(list_intersect(have, des)) / CAST(len(des) AS DOUBLE) END END AS v_skills,
  CASE WHEN required_years = 0 THEN 1.0 ELSE least(1.0, k / CAST(required_years AS DOUBLE)) END AS v_experience,
  CASE WHEN k % 2 <> 0 OR region = 'cdmx' OR lower(coalesce(location, '')) = 'cdmx' OR k = 6 THEN 1.0 ELSE 0.0 END AS v_location,
  CASE WHEN k % 3 <> 0 OR modality = 'remote' THEN 1.0 ELSE 0.0 END AS v_modality,
  CASE WHEN salary_max IS NULL OR salary_max >= 20000 THEN 1.0 ELSE 0.0 END AS v_salary,
  CASE WHEN lang IN ('en', 'de') THEN 1.0 ELSE 0.0 END AS v_auth, CASE WHEN k = 5 THEN 0.0 ELSE 1.0 END AS w_salary,
  k % 4 = 0 AND relocation AS excluded, list_distinct(list_concat(req, des)) AS asked FROM x),
s AS (SELECT *, round(100 * (v_skills * 2.0 + v_experience + 1.0 + 0.5 + v_location + v_modality + v_salary * w_salary + v_auth) / (2.0 + 1.0 + 1.0 + 1.0 + 1.0 + 1.0 + w_salary + 1.0), 2) AS raw FROM d)"""


@query(rf"""{_SCORES} SELECT job_id, k AS profile_id, CASE WHEN excluded THEN 0.0 ELSE raw END AS score, round(v_skills, 4) AS skills_match,
  array_to_string(list_sort([a FOR a IN asked IF list_contains(have, a)]), '|') AS matches,
  array_to_string(list_sort([a FOR a IN asked IF NOT list_contains(have, a)]), '|') AS gaps,
  CASE WHEN excluded THEN 'relocation' ELSE '' END AS exclusions,
  array_to_string(list_sort(['Close gap: ' || a FOR a IN asked IF NOT list_contains(have, a)])[1:5], '|') AS recommendations FROM s""")
def score_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(_pairs(spark, sf_dir))
    lists = [F.array_join(c, "|").alias(c) for c in ("matches", "gaps", "exclusions", "recommendations")]
    return scored.select("job_id", "profile_id", "score", F.col("breakdown.skills.match").alias("skills_match"), *lists)


_ASKED = """a AS (SELECT *, p_partkey AS k, list_distinct(string_split(lower(p_name), ' ')) AS names, list_distinct(string_split(lower(p_type), ' ')) AS kinds FROM part),
l AS (SELECT *, CASE WHEN k % 6 = 0 THEN [] ELSE names END AS required, CASE WHEN k % 4 = 0 THEN [] ELSE kinds END AS desirable,
  list_distinct([string_split(lower(p_name), ' ')[1], string_split(lower(p_type), ' ')[1], lower(p_brand)]) AS have, k % 9 AS years, CASE WHEN k % 7 > 0 THEN k % 7 END AS wanted FROM a),
m AS (SELECT k, CASE WHEN len(required) = 0 AND len(desirable) = 0 THEN 1.0 ELSE
    0.7 * CASE WHEN len(required) = 0 THEN 1.0 ELSE len(list_intersect(have, required)) / CAST(len(required) AS DOUBLE) END
    + 0.3 * CASE WHEN len(desirable) = 0 THEN 1.0 ELSE len(list_intersect(have, desirable)) / CAST(len(desirable) AS DOUBLE) END END AS skills,
  CASE WHEN wanted IS NULL THEN 1.0 ELSE least(1.0, years / CAST(wanted AS DOUBLE)) END AS experience,
  CASE WHEN k % 5 = 0 OR k % 3 = 0 OR k % 5 = k % 3 THEN 1.0 ELSE 0.0 END AS seniority,
  CASE WHEN len(desirable) = 0 THEN 1.0 ELSE len(list_intersect(have, desirable)) / CAST(len(desirable) AS DOUBLE) END AS language,
  CASE WHEN len(required) = 0 OR len(list_intersect(have, required)) > 0 OR k % 10 = 1 THEN 1.0 ELSE 0.0 END AS location,
  CASE WHEN len(desirable) = 0 OR list_contains(desirable, lower(CASE WHEN k % 2 = 0 THEN string_split(p_type, ' ')[1] ELSE p_brand END)) THEN 1.0 ELSE 0.0 END AS modality,
  CASE WHEN k % 8 = 0 OR p_retailprice >= p_size * 40 THEN 1.0 ELSE 0.0 END AS salary,
  CASE WHEN len(desirable) = 0 OR len(required) = 0 OR len(list_intersect(desirable, required)) > 0 THEN 1.0 ELSE 0.0 END AS work_authorization FROM l)"""


@query(f"""WITH {_ASKED} SELECT k AS job_id, round(skills, 6) AS skills, round(experience, 6) AS experience, CAST(seniority AS DOUBLE) AS seniority, round(language, 6) AS language, CAST(location AS DOUBLE) AS location,
  CAST(modality AS DOUBLE) AS modality, CAST(salary AS DOUBLE) AS salary, CAST(work_authorization AS DOUBLE) AS work_authorization,
  round(100 * (skills * (k % 3) + experience + seniority + language + location + modality + salary + work_authorization) / (k % 3 + 7.0), 2) AS score FROM m""")
def dimension_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension of a score by its own function, over parts whose words are skills, places and languages."""
    p, k = v.read(spark, sf_dir, "part"), F.col("p_partkey")
    none = F.array().cast("array<string>")
    p = p.withColumns({"names": scoring.tokens(F.split("p_name", " ")), "kinds": scoring.tokens(F.split("p_type", " "))})
    p = p.withColumns({
        "required": F.when(k % 6 == 0, none).otherwise(F.col("names")), "desirable": F.when(k % 4 == 0, none).otherwise(F.col("kinds")),
        "have": F.array_distinct(F.array(F.col("names")[0], F.col("kinds")[0], F.lower("p_brand"))),
    })
    have, required, desirable = F.col("have"), F.col("required"), F.col("desirable")
    rank = [F.when(k % n > 0, F.concat(F.lit("Level "), (k % n).cast("string"))) for n in (5, 3)]
    matches = {
        "skills": scoring.skills_match(have, required, desirable), "experience": scoring.experience_match(k % 9, (k % 7).cast("double")),
        "seniority": scoring.seniority_match(F.upper(rank[0]), rank[1]), "language": scoring.language_match(have, desirable),
        "location": scoring.location_match(have, required, k % 10 == 1), "modality": scoring.modality_match(F.when(k % 2 == 0, F.col("kinds")[0]).otherwise(F.col("p_brand")), desirable),
        "salary": scoring.salary_match(F.col("p_retailprice"), F.when(k % 8 > 0, F.col("p_size") * 40)), "work_authorization": scoring.authorization_match(desirable, required),
    }
    weights = {d: (k % 3).cast("double") if d == "skills" else F.lit(1.0) for d in matches}
    shown = [F.round(c, 6).alias(d) if d in ("skills", "experience", "language") else c.alias(d) for d, c in matches.items()]
    return p.select(k.alias("job_id"), *shown, scoring.weighted_score(matches, weights).alias("score"))


@query(f"""{_SCORES} SELECT k AS profile_id, count(*) AS pairs, max(CASE WHEN excluded THEN 0.0 ELSE raw END) AS best FROM s GROUP BY 1""")
def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(_pairs(spark, sf_dir))
    return scored.groupBy("profile_id").agg(F.count("*").alias("pairs"), F.max("score").alias("best"))


@query("""SELECT user_id % 10 AS profile_id, event_id AS job_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events) WHERE n <= 25""")
def bounded_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("profile_id"), F.col("event_id").alias("job_id"))
    return scoring.bounded_evaluation(e, 25)


@query("""SELECT p_partkey AS job_id, CAST(1 AS INTEGER) AS profile_id FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0""")
def stale_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose earlier evaluation is absent (every fourth) or of another name (every fifth)."""
    pairs = v.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"), F.lit(1).alias("profile_id"), "p_name")
    before = pairs.filter("job_id % 4 <> 0").withColumn("p_name", F.when(F.col("job_id") % 5 == 0, "old").otherwise(F.col("p_name")))
    before = before.select("job_id", "profile_id", scoring.input_fingerprint(["p_name"]).alias("fingerprint"))
    return scoring.needs_evaluation(pairs, before, ["p_name"]).select("job_id", "profile_id")


@query("""SELECT p_partkey AS job_id, 1 AS profile_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'told' ELSE p_name END AS matches,
  CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'local' ELSE 'deterministic-fallback' END AS model, p_retailprice AS score FROM part""")
def narrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.read(spark, sf_dir, "part")
    scores = p.select(F.col("p_partkey").alias("job_id"), F.lit(1).alias("profile_id"), F.array("p_name").alias("matches"), F.array("p_type").alias("gaps"), F.array("p_brand").alias("recommendations"), F.col("p_retailprice").alias("score"))
    told = F.array(F.lit("told"))
    narratives = scores.filter("job_id % 3 = 0").select("job_id", "profile_id", told.alias("matches"), F.when(F.col("job_id") % 2 == 0, told).alias("gaps"), told.alias("recommendations"), F.lit("local").alias("model"))
    out = scoring.overlay_narrative(scores, narratives)
    return out.select("job_id", "profile_id", F.array_join("matches", "|").alias("matches"), "model", "score")


@query(f"""WITH {v.JOBS}, {v.EVALUATIONS}, best AS (SELECT job_id, max(score) AS score FROM evaluations GROUP BY 1)
SELECT j.job_id, title, company, region, modality, status, detected_at, score FROM jobs j LEFT JOIN best b ON j.job_id = b.job_id""")
def list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.job_list_rows(listing.scored_jobs(v.jobs(spark, sf_dir), v.evaluations(spark, sf_dir)))
    return rows.drop("location", "description_url", "application_url", "published_at")


@query(f"""WITH {v.DOC_POSTINGS}, p AS (SELECT *, {REGION} AS region, {MODALITY} AS modality FROM doc_postings)
SELECT job_id, n_nationkey AS profile_id, length(left(description, 12000)) AS description_chars, title, coalesce(location, '') AS location, region, modality
FROM p, nation""")
def safe_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.doc_postings(spark, sf_dir).select("job_id", "title", "company", "description")
    postings, profiles, preferences = _scoring_inputs(spark, sf_dir)
    jobs = postings.join(d, "job_id").withColumn("safe_job", listing.safe_job()).drop(*d.drop("job_id").columns)
    payload = listing.safe_payload(scoring.pair(jobs, profiles, preferences))
    # Each payload is parsed once.
    said = F.from_json("payload", "job struct<title:string,description:string,location:string,region:string,modality:string>")["job"]
    chars = F.length("said.description").cast("long").alias("description_chars")
    return payload.select("job_id", "profile_id", said.alias("said")).select("job_id", "profile_id", chars, *[f"said.{c}" for c in ("title", "location", "region", "modality")])


@query("SELECT min(c_custkey) AS profile_id FROM customer")
def default_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.default_profile(v.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id")))


@query("SELECT c_custkey AS profile_id FROM customer WHERE c_acctbal < 0")
def reevaluation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.read(spark, sf_dir, "customer")
    return history.reevaluation_queue(c.select(F.col("c_custkey").alias("profile_id"), (F.col("c_acctbal") < 0).alias("needs_reevaluation"))).select("profile_id")
