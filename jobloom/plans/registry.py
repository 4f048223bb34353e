"""Queries of sources, payload checks, metadata, redaction, mirror pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.fields import parse_currency, salary_label
from jobloom.functions.text import drop_secret_keys, redact_columns
from jobloom.operators import identity, policy, resume
from jobloom.plans import views as v
from jobloom.plans.catalog import query
from jobloom.sources import feeds, tables
from jobloom.sources.scratch import scratch_dir
from jobloom.streaming.ingest import suppress_duplicates

ADAPTERS = ("json-api-feed", "career-page", "greenhouse-career-page", "lever-career-page")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as source configurations, good and bad ones."""
    k = F.col("s_suppkey")
    setting = F.map_filter(
        F.create_map(
            F.lit("allow_network"), F.when(k % 9 < 3, "true").when(k % 9 < 6, "false").when(k % 9 == 6, "maybe"),
            F.lit("payload"), F.when(k % 4 == 1, "{}"), F.lit("html_path"), F.when(k % 4 == 2, "page.html"),
        ),
        lambda _, x: x.isNotNull(),
    )
    return v.read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.when(k % 5 == 0, "api").when(k % 5 == 1, "feed").when(k % 5 == 2, "career-page").otherwise("mail").alias("kind"),
        F.when(k % 4 == 0, "https://boards.greenhouse.io/x").when(k % 4 == 1, "https://jobs.lever.co/x")
        .when(k % 4 == 2, "ftp://x.example").alias("base_url"),
        F.when(k % 6 == 0, "Lever").alias("provider"),
        F.when(k % 7 == 0, "career-page").when(k % 7 == 1, "none-such").alias("adapter_override"),
        F.lit("https://x.example/terms").alias("terms_url"),
        (k % 2 == 0).alias("terms_accepted"),
        (k % 8).alias("requests_per_minute"),
        setting.alias("config"),
    )


_SOURCES = """sources AS (
  SELECT s_suppkey AS k, s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'feed' WHEN 2 THEN 'career-page' ELSE 'mail' END AS kind,
         CASE s_suppkey % 4 WHEN 0 THEN 'https://boards.greenhouse.io/x' WHEN 1 THEN 'https://jobs.lever.co/x' WHEN 2 THEN 'ftp://x.example' END AS base_url,
         CASE WHEN s_suppkey % 6 = 0 THEN 'Lever' END AS provider,
         CASE s_suppkey % 7 WHEN 0 THEN 'career-page' WHEN 1 THEN 'none-such' END AS wanted FROM supplier),
routed AS (
  SELECT *, CASE WHEN wanted IS NOT NULL THEN CASE WHEN wanted = 'career-page' THEN wanted END
    WHEN kind IN ('api', 'feed') THEN 'json-api-feed' WHEN kind = 'career-page' THEN kind
    WHEN base_url LIKE '%greenhouse.io/%' THEN 'greenhouse-career-page'
    WHEN provider = 'Lever' OR base_url LIKE '%lever.co/%' THEN 'lever-career-page' END AS adapter FROM sources)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(a,) for a in ADAPTERS], "adapter string")
    return policy.route_sources(_sources(spark, sf_dir), known)


@query(f"WITH {_SOURCES} SELECT name, kind, adapter FROM routed")
def routed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("name", "kind", "adapter")


@query(f"""WITH {_SOURCES} SELECT name, concat_ws(';', CASE WHEN k % 4 = 2 THEN 'base_url:value_error' END,
  CASE WHEN k % 9 = 6 THEN 'config.allow_network:bool_type' END, CASE WHEN k % 2 = 1 THEN 'terms_accepted:value_error' END,
  CASE WHEN k % 8 = 0 THEN 'requests_per_minute:value_error' END, CASE WHEN adapter IS NULL THEN 'config.adapter:value_error' END,
  CASE WHEN adapter IS NOT NULL AND k % 9 < 3 AND k % 4 = 3 THEN 'base_url:value_error' END,
  CASE WHEN adapter IS NOT NULL AND k % 9 >= 3 AND NOT CASE WHEN adapter = 'json-api-feed' THEN k % 4 = 1 ELSE k % 4 = 2 END
    THEN 'config:value_error' END) AS problems FROM routed""")
def source_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = policy.validate_sources(_routed(spark, sf_dir))
    said = F.transform("violations", lambda x: F.concat(x["field"], F.lit(":"), x["type"]))
    return checked.select("name", F.array_join(said, ";").alias("problems"))


@query("""SELECT c_custkey, '[REDACTED]' AS api_key, c_mktsegment AS segment, 'Bearer [REDACTED] of ' || c_name AS note,
  '[REDACTED]' AS password, c_name AS owner, 1 AS settings_kept FROM customer""")
def redacted_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    bearer = F.concat(F.lit("Bearer abc.def-"), F.col("c_custkey").cast("string"), F.lit(" of "), name)
    settings = F.create_map(F.lit("api_key"), name, F.lit("segment"), F.col("c_mktsegment"))
    log = F.struct(settings.alias("settings"), F.array(bearer).alias("notes"), F.struct(name.alias("password"), name.alias("owner")).alias("account"))
    rows = v.read(spark, sf_dir, "customer").select("c_custkey", log.alias("log"), drop_secret_keys(F.create_map(F.lit("token"), name, F.lit("segment"), name)).alias("kept"))
    done = redact_columns(rows, "log")
    return done.select(
        "c_custkey", F.col("log.settings")["api_key"].alias("api_key"), F.col("log.settings")["segment"].alias("segment"),
        F.col("log.notes")[0].alias("note"), F.col("log.account.password").alias("password"), F.col("log.account.owner").alias("owner"),
        F.size("kept").alias("settings_kept"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'feed' END AS source_adapter,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 3 = 1 THEN '["' || o_orderstatus || '"]' END AS provider_metadata,
  '["' || o_orderstatus || '","SQL"]' AS requirements FROM orders""")
def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    given = (
        F.when(k % 3 == 0, F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("source_adapter"), F.col("o_orderstatus").alias("status")).alias("metadata"))))
        .when(k % 3 == 1, F.to_json(F.struct(F.array("o_orderstatus").alias("metadata")))).otherwise("{}")
    )
    merged = feeds.merge_metadata(F.try_parse_json(given), F.lit("feed"), F.array("o_orderstatus", F.lit("SQL")))
    rows = v.read(spark, sf_dir, "orders").select("o_orderkey", merged.alias("m"))
    keys = ("source_adapter", "status", "provider_metadata", "requirements")
    return rows.select("o_orderkey", *[F.try_element_at("m", F.lit(x)).alias(x) for x in keys])


@query("""WITH p AS (SELECT user_id, event_type AS k, CAST(event_id AS VARCHAR) AS val, event_id FROM events
  UNION ALL SELECT user_id, 'last', event_type, event_id FROM events),
m AS (SELECT user_id, k, arg_max(val, event_id) AS val FROM p GROUP BY 1, 2)
SELECT user_id, string_agg(k || '=' || val, ',' ORDER BY k) AS metadata FROM m GROUP BY 1""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.create_map("event_type", F.col("event_id").cast("string"), F.lit("last"), F.col("event_type"))
    rows = v.read(spark, sf_dir, "events").select(F.col("user_id").alias("identity"), F.col("event_id").alias("seq"), given.alias("metadata"))
    merged = identity.merge_metadata(rows, "metadata")
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select(F.col("identity").alias("user_id"), F.array_join(F.array_sort(pairs), ",").alias("metadata"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'payload is not valid JSON' WHEN o_orderkey % 6 = 1 THEN 'payload must be an object'
  WHEN count(l_orderkey) = 0 THEN 'jobs must be a non-empty list'
  WHEN min(l_linenumber) FILTER (WHERE l_returnflag = 'R') IS NOT NULL
  THEN 'job ' || CAST(min(nth) FILTER (WHERE l_returnflag = 'R') AS BIGINT) || ' needs description_url or url' END AS error
  FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem) ON o_orderkey = l_orderkey
  GROUP BY o_orderkey""")
def payload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payloads with a job for each line; returned lines have no link, and keys break some payloads."""
    line = v.read(spark, sf_dir, "lineitem")
    link = F.when(F.col("l_returnflag") != "R", F.concat(F.lit("/l/"), F.col("l_partkey").cast("string")))
    job = F.struct(F.col("l_returnflag").alias("title"), link.alias("url"))
    placed = F.struct("l_linenumber", "l_partkey", "l_suppkey", job.alias("job"))
    jobs = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["job"]).alias("jobs"))
    rows = v.read(spark, sf_dir, "orders").join(jobs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    listed = F.coalesce("jobs", F.array().cast(dict(jobs.dtypes)["jobs"]))
    k = F.col("o_orderkey") % 6
    whole = F.when(k % 2 == 0, F.to_json(F.struct(listed.alias("jobs")))).otherwise(F.to_json(F.struct(listed.alias("data"))))
    payload = F.when(k == 0, F.left(whole, F.length(whole) - 1)).when(k == 1, F.to_json(listed)).otherwise(whole)
    return feeds.validate_payloads(rows.select("o_orderkey", payload.alias("payload"))).select("o_orderkey", "error")


@query("""SELECT 'page-' || p_partkey AS page_id, p_name AS title, nullif(p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE '' END, '') AS company,
  CASE p_partkey % 3 WHEN 0 THEN 'cdmx' WHEN 1 THEN 'usa' END AS region, 'fp' || p_partkey AS fingerprint FROM part""")
def mirror_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")

    def rich(*pieces):
        return F.array(*[F.struct(p.alias("plain_text")) for p in pieces])

    brand = F.when(k % 2 == 0, rich(F.col("p_brand"), F.concat(F.lit(" "), "p_type"))).otherwise(rich(F.col("p_brand")))
    region = F.when(k % 3 == 0, "cdmx").when(k % 3 == 1, "usa")
    properties = F.struct(
        F.struct(rich(F.col("p_name")).alias("title")).alias("Title"),
        F.struct(brand.alias("rich_text")).alias("Company"),
        F.struct(F.struct(region.alias("name")).alias("select")).alias("Region"),
        F.struct(rich(F.concat(F.lit("fp"), k.cast("string"))).alias("rich_text")).alias("Fingerprint"),
    )
    page = F.to_json(F.struct(F.concat(F.lit("page-"), k.cast("string")).alias("id"), properties.alias("properties")))
    scanned = tables.scan_mirror_pages(v.read(spark, sf_dir, "part").select(page.alias("json")))
    return scanned.select("page_id", *[F.col(c).alias(c.lower()) for c in ("Title", "Company", "Region", "Fingerprint")])


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'invalid file name' WHEN doc_id % 5 = 3 THEN 'unsupported file type'
  WHEN doc_id % 5 = 2 AND coalesce(text, '') = '' THEN 'empty file'
  WHEN doc_id % 5 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'file type does not match' END
  WHEN doc_id % 5 = 1 AND coalesce(text, '') = '' THEN 'empty file' WHEN doc_id % 5 = 1 AND left(text, 5) <> '%PDF-' THEN 'not a PDF file' END AS error
  FROM documents""")
def resume_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    end = F.get(F.array(*map(F.lit, (".pdf", ".PDF", ".docx", ".odt", "\\.pdf"))), (k % 5).cast("int"))
    mime = F.when((k % 5 == 2) & (k % 2 == 0), "application/pdf").when(k % 5 < 2, "application/pdf")
    content = F.when(k % 5 == 0, F.concat(F.lit("%PDF-1.7\n"), text)).otherwise(text).cast("binary")
    files = v.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("cv"), k.cast("string"), end).alias("name"), mime.alias("mime"), content.alias("content"))
    return resume.validate_resume_files(files).select("doc_id", "error")


@query(f"""WITH {v.DOC_POSTINGS} SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'Not specified'
  ELSE '$' || format('{{:,}}', n_chars * 10) || '–$' || format('{{:,}}', n_chars * 12) || ' MXN/year' END AS label FROM doc_postings""")
def salary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    high = F.when(F.col("job_id") % 3 != 0, n * 12)
    return v.doc_postings(spark, sf_dir).select("job_id", salary_label(n * 10, high, parse_currency(F.col("salary_text"))).alias("label"))


@query("SELECT DISTINCT 'https://jobs.example/' || user_id AS canonical_url FROM events")
def streamed_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings arrive as a stream; each posting passes once within the watermark's delay."""
    rows = v.read(spark, sf_dir, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may match one file
    url = F.concat(F.lit("HTTPS://jobs.example/"), F.col("user_id").cast("string"), F.lit("/?utm_source="), "event_type")
    seen = suppress_duplicates(stream.select(F.col("ts").alias("detected_at"), url.alias("url")), "3650 days")
    out = f"{scratch_dir(spark)}/streamed-{spark.sql('SELECT uuid()').first()[0]}"
    writer = seen.select("canonical_url").writeStream.format("parquet").option("path", f"{out}/rows")
    writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("canonical_url string").parquet(f"{out}/rows")
