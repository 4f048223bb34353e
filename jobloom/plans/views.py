"""Posting-shaped views over the given tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = (
    "Ciudad de México", "Zapopan, Jalisco", "Austin, United States", "Monterrey, Nuevo León",
    "Berlin, Germany", "Remote - USA", "CDMX / United States",
)
MODES = ("Remote", "hybrid role", "On-site", "head office", "flexible")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks by a unique key.

    A file of very many short rows is read by few tasks; work that is heavy for each row would stay in these.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings."""
    d = read(spark, sf_dir, "documents")
    place = F.get(F.array(*map(F.lit, PLACES)), F.pmod("doc_id", F.lit(8)).cast("int"))
    mode = F.get(F.array(*map(F.lit, MODES)), F.pmod("doc_id", F.lit(5)).cast("int"))
    money = F.concat(
        F.lit("$"), (F.col("n_chars") * 10).cast("string"), F.lit("-$"), (F.col("n_chars") * 12).cast("string"), F.lit(" MXN")
    )
    return d.select(
        F.col("doc_id").alias("job_id"),
        F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){0,5})", 1).alias("title"),
        F.col("source").alias("company"), F.col("text").alias("description"), place.alias("location"),
        mode.alias("mode_text"), money.alias("salary_text"), "n_chars", "lang",
    )


def _case(expr: str, values: tuple[str, ...]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


DOC_POSTINGS = rf"""doc_postings AS (
  SELECT doc_id AS job_id, regexp_extract(text, '^\s*(\S+(?:\s+\S+){{0,5}})', 1) AS title, source AS company,
         text AS description, {_case("doc_id % 8", PLACES)} AS location, {_case("doc_id % 5", MODES)} AS mode_text,
         '$' || (n_chars * 10) || '-$' || (n_chars * 12) || ' MXN' AS salary_text, n_chars, lang
  FROM documents)"""


def ident(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Parts as sightings of postings; URL and fingerprint overlaps form chains of up to eight. ``more`` columns of the parts follow."""
    p = spread(read(spark, sf_dir, "part"), "p_partkey")
    k = F.col("p_partkey")
    block, step = F.floor(k / 8), F.floor(F.pmod(k, F.lit(8)) / 2)
    track = F.when(k % 2 == 0, F.lit("?utm_source=mail")).otherwise(F.lit("#top"))
    return p.select(
        k.alias("seq"),
        F.concat(F.lit("https://jobs.example/"), (block * 10 + step).cast("string"), track).alias("url"),
        F.col("p_type").alias("title"), F.concat(F.lit("co"), block.cast("string")).alias("company"),
        F.when(k % 3 == 0, "unknown").otherwise(F.col("p_brand")).alias("modality"),
        F.when(k % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("description"),
        F.col("p_retailprice").alias("salary_min"),
        F.when(k % 5 > 1, k % 7).cast("int").alias("source_id"), *more,
    )


IDENT = """ident AS (
  SELECT p_partkey AS seq,
         'https://jobs.example/' || ((p_partkey // 8) * 10 + (p_partkey % 8) // 2)
           || CASE WHEN p_partkey % 2 = 0 THEN '?utm_source=mail' ELSE '#top' END AS url,
         p_type AS title, 'co' || (p_partkey // 8) AS company,
         CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE p_brand END AS modality,
         CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_name END AS description, p_retailprice AS salary_min,
         CASE WHEN p_partkey % 5 > 1 THEN CAST(p_partkey % 7 AS INTEGER) END AS source_id,
         'https://jobs.example/' || ((p_partkey // 8) * 10 + (p_partkey % 8) // 2) AS canonical_url
  FROM part)"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("evaluation_id"), F.get_json_object("props", "$.k").cast("long").alias("job_id"),
        (F.col("user_id") % 10).alias("profile_id"), F.col("value").alias("score"), F.col("ts").alias("evaluated_at"),
    )


EVALUATIONS = """evaluations AS (
  SELECT event_id AS evaluation_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, user_id % 10 AS profile_id,
         value AS score, ts AS evaluated_at FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stored postings."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    regions = F.array(*map(F.lit, ("cdmx", "guadalajara", "mexico", "usa", "other")))
    modes = F.array(*map(F.lit, ("remote", "hybrid", "onsite", "unknown")))
    return p.select(
        k.alias("job_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("description"),
        F.get(regions, (k % 5).cast("int")).alias("region"), F.get(modes, (k % 4).cast("int")).alias("modality"),
        F.when(k % 7 == 0, "inactive").otherwise("active").alias("status"), (k % 6).alias("source_id"),
        F.col("p_size").alias("detected_at"),
    )


JOBS = f"""jobs AS (
  SELECT p_partkey AS job_id, p_name AS title, p_brand AS company, p_type AS description,
         {_case("p_partkey % 5", ("cdmx", "guadalajara", "mexico", "usa", "other"))} AS region,
         {_case("p_partkey % 4", ("remote", "hybrid", "onsite", "unknown"))} AS modality,
         CASE WHEN p_partkey % 7 = 0 THEN 'inactive' ELSE 'active' END AS status, p_partkey % 6 AS source_id,
         p_size AS detected_at FROM part)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of postings, by user."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("identity"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "unknown").when(kind != "view", kind).alias("description"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string"))).alias("description_url"),
        F.lit(None).cast("string").alias("application_url"), "value",
    )


VERSIONS = """versions AS (
  SELECT user_id AS identity, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type <> 'view' THEN event_type END AS description,
         CASE WHEN event_id % 3 = 0 THEN 'u' || (event_id % 4) END AS description_url, value FROM events)"""


def mirror(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(local rows, mirror pages): some missing, some stale, some orphans, some matched by id only."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    local = p.select(k.alias("job_id"), F.concat(F.lit("fp"), k.cast("string")).alias("fingerprint"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"))
    there = p.filter(k % 7 != 0).select(
        (k + 1_000_000).alias("page_id"),
        F.when(k % 13 != 0, F.concat(F.lit("fp"), k.cast("string"))).alias("fingerprint"),
        k.cast("string").alias("local_id"),
        F.when(k % 11 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("title"),
        F.when(k % 22 == 0, F.lit("?")).otherwise(F.col("p_brand")).alias("company"),
    )
    orphans = p.filter(k % 50 == 0).select(
        (k + 9_000_000).alias("page_id"), F.concat(F.lit("gone"), k.cast("string")).alias("fingerprint"),
        F.lit(None).cast("string").alias("local_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
    )
    return local, there.unionByName(orphans)


MIRROR = """local AS (SELECT p_partkey AS job_id, 'fp' || p_partkey AS fingerprint, p_name AS title, p_brand AS company FROM part),
pages_ AS (
  SELECT p_partkey + 1000000 AS page_id, CASE WHEN p_partkey % 13 <> 0 THEN 'fp' || p_partkey END AS fingerprint,
         CAST(p_partkey AS VARCHAR) AS local_id, CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE p_name END AS title,
         CASE WHEN p_partkey % 22 = 0 THEN '?' ELSE p_brand END AS company FROM part WHERE p_partkey % 7 <> 0
  UNION ALL
  SELECT p_partkey + 9000000, 'gone' || p_partkey, NULL, p_name, p_brand FROM part WHERE p_partkey % 50 = 0),
matched AS (
  SELECT l.*, coalesce(a.page_id, b.page_id) AS page_id FROM local l
  LEFT JOIN (SELECT fingerprint, min(page_id) AS page_id FROM pages_ GROUP BY 1) a ON l.fingerprint = a.fingerprint
  LEFT JOIN (SELECT local_id, min(page_id) AS page_id FROM pages_ GROUP BY 1) b ON CAST(l.job_id AS VARCHAR) = b.local_id),
differences AS (
  SELECT 'missing' AS kind, job_id, CAST(NULL AS BIGINT) AS page_id, '' AS fields, TRUE AS retryable FROM matched WHERE page_id IS NULL
  UNION ALL
  SELECT 'stale', m.job_id, m.page_id, concat_ws(',', CASE WHEN m.title IS DISTINCT FROM p.title THEN 'title' END,
         CASE WHEN m.company IS DISTINCT FROM p.company THEN 'company' END), TRUE
  FROM matched m JOIN pages_ p ON m.page_id = p.page_id
  WHERE m.title IS DISTINCT FROM p.title OR m.company IS DISTINCT FROM p.company
  UNION ALL
  SELECT 'orphan', NULL, page_id, '', FALSE FROM pages_ WHERE page_id NOT IN (SELECT page_id FROM matched WHERE page_id IS NOT NULL))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as source runs of executions."""
    line = read(spark, sf_dir, "lineitem")
    found = F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_quantity").cast("long"))
    return line.select(
        F.col("l_orderkey").alias("execution_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"),
        found.alias("jobs_found"), F.when(found == 0, "failed").otherwise("success").alias("status"),
        F.when(F.col("l_linestatus") == "O", found).otherwise(0).alias("scored"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("issues"),
    )


RUNS = """runs AS (
  SELECT l_orderkey AS execution_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS run_id,
         CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS jobs_found,
         CASE WHEN l_returnflag = 'A' OR CAST(l_quantity AS BIGINT) = 0 THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS scored,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS issues FROM lineitem)"""
