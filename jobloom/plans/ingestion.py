"""Queries of card pages, feed items, composed runs, tables and SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobloom.functions.links import canonicalize_url, fingerprint
from jobloom.functions.sql import register_sql_functions
from jobloom.operators import ledger, listing, pipeline, resume, runs, scoring
from jobloom.operators.numbering import number_rows
from jobloom.plans import views as v
from jobloom.plans.catalog import ORACLE_SQL, QUERIES, query
from jobloom.plans.normalization import REGION, _resumes
from jobloom.plans.postings import _SCORES, _scoring_inputs
from jobloom.plans.registry import _SOURCES, _sources
from jobloom.sources import cards, feeds, tables
from jobloom.sources.scratch import scratch_dir
from jobloom.streaming.ingest import SIGHTING, ingest_into, posting_ledger


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _said(*parts) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as career pages: cards of each kind, one without a link to its description, and one that never ends."""
    k, name = F.col("p_partkey"), F.col("p_name")
    key = k.cast("string")
    page = (
        F.when(k % 4 == 0, _said('<article><h1 class="job-title">', name, ' &amp; <b>co</b></h1><a href="/p/', key, '">Details</a><a href="/p/', key, '/apply">Apply now</a></article>'))
        .when(k % 4 == 1, _said("<ul><li class='x job-card'><b data-field=\"title\">", name, '</b><i data-field=company>', F.col("p_brand"), '</i><a class="apply" href="/a/', key, '">go</a><a href="/p/', key, '"><b>more</b></a></li><li>no card</li></ul>'))
        .when(k % 4 == 2, _said('<p data-job="true"><span class="location">', F.col("p_type"), '</span><script>"<h1 class=title>no</h1>"</script><a href="/p/', key, '">Postular</a></article>'))
        .otherwise(_said("<article><h1 class=title>", name))
    )
    return v.spread(v.read(spark, sf_dir, "part"), "p_partkey").select(k.alias("source"), page.alias("html"), F.lit("https://jobs.example/x").alias("base_url"), F.lit("Example").alias("default_company"))


_CARDS = """SELECT p_partkey AS source, CASE p_partkey % 4 WHEN 0 THEN p_name || ' &' WHEN 1 THEN p_name END AS title, CASE WHEN p_partkey % 4 = 1 THEN p_brand END AS company,
  CASE WHEN p_partkey % 4 = 2 THEN p_type END AS location, CASE WHEN p_partkey % 4 < 2 THEN '/p/' || p_partkey END AS url,
  CASE p_partkey % 4 WHEN 0 THEN '/p/' || p_partkey || '/apply' WHEN 1 THEN '/a/' || p_partkey ELSE '/p/' || p_partkey END AS application_url
  FROM part WHERE p_partkey % 4 < 3"""


@query(_CARDS)
def career_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cards.scan_cards(_card_pages(spark, sf_dir))
    return found.select("source", *[F.col("fields")[f].alias(f) for f in ("title", "company", "location")], "url", "application_url")


@query(_CARDS)
def sql_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the SQL table function."""
    register_sql_functions(spark)
    _card_pages(spark, sf_dir).createOrReplaceTempView("career_pages")
    return spark.sql(
        "SELECT p.source, c.fields['title'] AS title, c.fields['company'] AS company, c.fields['location'] AS location, c.url, c.application_url "
        "FROM career_pages p, LATERAL scan_cards(p.html) c"
    )


@query(f"""WITH c AS ({_CARDS}) SELECT source, CASE WHEN url IS NULL THEN 'invalid job: description URL is required' END AS error,
  coalesce(title, 'Untitled role') AS title, coalesce(company, 'Example') AS company, location, 'https://jobs.example' || url AS description_url,
  'https://jobs.example' || application_url AS application_url FROM c""")
def card_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as postings, and those that are set aside."""
    good, bad = feeds.read_feeds(_card_pages(spark, sf_dir))
    rows = good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    return rows.select("source", "error", "title", "company", "location", "description_url", "application_url")


@query(f"""WITH u AS ({ORACLE_SQL["canonicalize_page_urls"]}), t AS ({ORACLE_SQL["sanitize_pages"]}) SELECT page_id, canonical_url FROM u""")
def sql_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql_functions(spark)
    v.read(spark, sf_dir, "pages").createOrReplaceTempView("some_pages")
    return spark.sql("SELECT page_id, posting_url(url) AS canonical_url FROM some_pages")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderstatus
  WHEN 3 THEN o_orderstatus || ', ' || o_orderpriority WHEN 4 THEN o_orderpriority END AS location FROM orders""")
def item_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text, status = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    item = (
        F.when(k % 6 == 0, F.to_json(F.struct(text.alias("location"))))
        .when(k % 6 == 1, F.to_json(F.struct(F.struct(text.alias("name"), status.alias("location")).alias("location"))))
        .when(k % 6 == 2, F.to_json(F.struct(F.lit("").alias("location"), F.struct(status.alias("location")).alias("jobGeo"))))
        .when(k % 6 == 3, F.to_json(F.struct(F.array(status, text).alias("locations"))))
        .when(k % 6 == 4, F.to_json(F.struct(F.struct(text.alias("location")).alias("categories"))))
        .otherwise(F.to_json(F.struct(F.lit(" ").alias("location"))))
    )
    return v.read(spark, sf_dir, "orders").select("o_orderkey", feeds.pick_location(F.try_parse_json(item)).alias("location"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0")
def items_without_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    legal = F.struct(F.col("o_orderpriority").alias("note")).alias("legal")
    item = F.when(k % 3 == 0, F.to_json(F.struct(legal))).when(k % 3 == 1, F.to_json(F.struct(legal, F.col("o_orderstatus").alias("title"))))
    items = v.read(spark, sf_dir, "orders").select("o_orderkey", F.try_parse_json(F.coalesce(item, F.to_json(F.struct("o_orderstatus")))).alias("item"))
    return feeds.drop_legal_envelope(items).select("o_orderkey")


@query("""SELECT CAST(user_id AS VARCHAR) AS source, event_id, 'invalid job: item must be an object with a description URL; company is required' AS error FROM events WHERE event_type = 'error'""")
def rejected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feeds of one item; errors send a bare text."""
    item = F.struct(F.col("event_type").alias("title"), F.lit("C").alias("company"), F.lit("/x").alias("url"))
    payload = F.when(F.col("event_type") == "error", F.to_json(F.array("event_type"))).otherwise(F.to_json(F.array(item)))
    raw = v.spread(v.read(spark, sf_dir, "events"), "event_id").select(
        F.col("user_id").cast("string").alias("source"), "event_id", F.lit("https://jobs.example/").alias("base_url"),
        F.lit(None).cast("string").alias("default_company"), payload.alias("payload"),
    )
    _, bad = feeds.read_feeds(raw)
    rejected = bad.filter(F.col("error").contains("must be an object"))
    return rejected.select("source", "event_id", F.regexp_replace("error", "; description URL is required", "").alias("error"))


@query("""SELECT source, item_idx, CAST(row_number() OVER (ORDER BY source, item_idx) AS INTEGER) AS place FROM (
  SELECT 's' || s_nationkey AS source, s_suppkey AS item_idx FROM supplier UNION ALL SELECT 'n' || n_regionkey, n_nationkey FROM nation)""")
def ordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two kinds of sources in one order: source, then position."""
    a = v.read(spark, sf_dir, "supplier").select(_said("s", F.col("s_nationkey").cast("string")).alias("source"), F.col("s_suppkey").cast("long").alias("item_idx"), "s_name")
    b = v.read(spark, sf_dir, "nation").select(_said("n", F.col("n_regionkey").cast("string")).alias("source"), F.col("n_nationkey").cast("long").alias("item_idx"))
    placed = number_rows(feeds.union_sources(a, b), list(feeds.SOURCE_ORDER), "place")
    return placed.select("source", "item_idx", F.col("place").cast("int").alias("place"))


#: Keys of suppliers that share the pages of a feed; a page has at most as many items.
PAGE = 400


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as postings of their nations, in three sources of pages of some hundred items; every fifth has no company."""
    s = v.read(spark, sf_dir, "supplier")
    nation, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey")
    item = F.struct(
        k.alias("k"), _said("T", nation).alias("title"), F.when(k % 5 > 0, _said("C", nation)).alias("company"), F.col("s_name").alias("description"),
        _said("/n/", nation, "?utm_source=", k.cast("string")).alias("url"),
        F.struct(F.to_json(F.array(_said("skill", nation))).alias("required_skills"), F.col("s_name").alias("last")).alias("metadata"),
    )
    source = (k % 3).cast("string").alias("source")
    feed = s.groupBy(source, F.floor(k / PAGE).alias("page")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))
    return feed.select("source", "page", F.lit("https://jobs.example/").alias("base_url"), F.lit(None).cast("string").alias("default_company"), "payload")


_INGESTED = """SELECT 'T' || s_nationkey AS title, 'https://jobs.example/n/' || s_nationkey AS canonical_url,
  arg_max(s_name, (CAST(s_suppkey % 3 AS VARCHAR), s_suppkey)) AS description, count(*) AS sightings FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY s_nationkey"""


@query(f"WITH i AS ({_INGESTED}) SELECT title, canonical_url, description, sightings, description AS last_name FROM i")
def ingested_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipeline.run_ingest(_feed(spark, sf_dir))["postings"]
    return made.select("title", "canonical_url", "description", "sightings", F.col("metadata")["last"].alias("last_name"))


@query(f"WITH i AS ({_INGESTED}) SELECT title, 2 * sightings AS sightings, description FROM i")
def continued_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feeds twice: sightings of the first run are the stored ones of the second."""
    feed = _feed(spark, sf_dir)
    return pipeline.run_ingest(feed, pipeline.run_ingest(feed)["sightings"])["postings"].select("title", "sightings", "description")


@query("""SELECT CAST(s_suppkey % 3 AS VARCHAR) AS source, count(*) FILTER (WHERE s_suppkey % 5 > 0) AS jobs_found, count(*) FILTER (WHERE s_suppkey % 5 = 0) AS errors,
  CASE WHEN count(*) FILTER (WHERE s_suppkey % 5 > 0) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE s_suppkey % 5 = 0) > 0 THEN 'partial' ELSE 'success' END AS status FROM supplier GROUP BY 1""")
def ingested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run_ingest(_feed(spark, sf_dir))["source_runs"].select("source", "jobs_found", "errors", "status")


@query(f"WITH i AS ({_INGESTED}) SELECT title, canonical_url, description, sightings, description AS last_name, 'active' AS status FROM i")
def incremental_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that arrive in two calls of the stream; a third call finds nothing new. Each batch meets the ledger of the ones before."""
    folder, root = _folder(spark, "feeds"), _folder(spark, "ingested")
    feed = _feed(spark, sf_dir)
    for source in ("0", "1", "2", None):
        if source is not None:
            feed.filter(F.col("source") == source).write.mode("append").json(folder)
        if source != "0":
            ingest_into(spark, folder, f"{root}/checkpoint", root)
    found = posting_ledger(spark, root).postings()
    return found.select("title", "canonical_url", "description", "sightings", F.col("metadata")["last"].alias("last_name"), "status")


@query("""WITH n AS (SELECT s_nationkey, min((CAST(s_suppkey % 3 AS VARCHAR), s_suppkey)) AS first FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY 1)
SELECT 'T' || s_nationkey AS title, 1 AS ids, 'T' || s_nationkey AS first_title, first[1] AS first_source FROM n""")
def stable_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed ingested three times, each run continuing the one before: a posting keeps one id, called after its first sighting."""
    feed, stored, seen = _feed(spark, sf_dir), None, []
    for _ in range(3):
        out = pipeline.run_ingest(feed, stored)
        stored = out["sightings"]
        seen.append(out["postings"].select("title", "identity"))
    every = seen[0].unionByName(seen[1]).unionByName(seen[2])
    ids = every.groupBy("title").agg(F.countDistinct("identity").cast("int").alias("ids"), F.min("identity").alias("seq"))
    first = stored.select("seq", F.col("title").alias("first_title"), F.col("source").alias("first_source"))
    return ids.join(first, "seq").select("title", "ids", "first_title", "first_source")


_LEDGER = """WITH RECURSIVE s AS (SELECT p_partkey AS k, p_partkey % 3 AS batch, p_partkey // 8 * 10 + (p_partkey % 8) // 2 AS url, p_partkey // 8 AS company, p_type AS title, p_name AS description FROM part),
reach(k, other) AS (SELECT k, k FROM s UNION SELECT r.k, b.k FROM reach r JOIN s a ON a.k = r.other JOIN s b ON b.company = a.company AND (b.url = a.url OR b.title = a.title)),
c AS (SELECT k, min(other) AS part FROM reach GROUP BY 1)"""


@query(f"""{_LEDGER}, f AS (SELECT part, min((batch, s.k)) AS first, arg_max(description, (batch, s.k)) AS description, count(*) AS sightings FROM s JOIN c ON s.k = c.k GROUP BY 1)
SELECT description, sightings, CAST(first[1] AS INTEGER) AS first_batch, first[2] AS first_part, count(*) OVER () AS postings FROM f""")
def ledger_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sightings that arrive in three batches; later ones connect postings of earlier ones, which become one."""
    rows = v.ident(spark, sf_dir, "p_name")
    kinds = {f.name: f.dataType for f in StructType.fromDDL(SIGHTING).fields}
    empty = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in rows.columns}
    batch, seq = F.col("seq") % 3, F.lpad(F.col("seq").cast("string"), 12, "0")
    rows = rows.withColumns({
        **empty, "batch": batch, "seq": F.concat(F.lpad(batch.cast("string"), 12, "0"), F.lit("|"), seq), "description": F.col("p_name"), "source": F.lit("part"),
        "canonical_url": canonicalize_url(F.col("url")), "fingerprint": fingerprint(F.col("title"), F.col("company"), F.lit(None).cast("string")),
    })
    book = posting_ledger(spark, _folder(spark, "ledger"), buckets=16)
    for number in range(3):
        book.ingest(rows.filter(F.col("batch") == number).select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]), number)
    found = book.postings()
    total = found.agg(F.count("*").alias("postings"))
    return found.join(F.broadcast(total)).select(  # a single row
        "description", "sightings", F.left("first_seq", F.lit(12)).cast("int").alias("first_batch"), F.substring("first_seq", 14, 12).cast("long").alias("first_part"), "postings"
    )


_EVENTS = """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS seen FROM events),
f AS (SELECT *, min(event_id) FILTER (WHERE seen) OVER (PARTITION BY user_id) AS first FROM e),
l AS (SELECT user_id, count(*) FILTER (WHERE seen) AS seen, count(*) FILTER (WHERE NOT seen AND event_id > first) AS missed,
  arg_max(seen, event_id) AS last_seen FROM f WHERE first IS NOT NULL GROUP BY 1)"""


@query(f"""{_EVENTS} SELECT user_id, seen, missed, CASE WHEN missed > 0 THEN 'inactive' ELSE 'active' END AS status,
  CASE WHEN last_seen THEN 'active' ELSE 'inactive' END AS reactivated FROM l""")
def posting_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of users' postings, errors as checks that missed them: status that lasts, and status that comes back."""
    e = v.read(spark, sf_dir, "events")
    seen = F.col("event_type") != "error"
    lasting = ledger.status_after(e, "user_id", "event_id", seen)
    back = ledger.status_after(e, "user_id", "event_id", seen, reactivate=True).select("user_id", F.col("status").alias("reactivated"))
    return lasting.join(back, "user_id")


@query("""WITH n AS (SELECT s_nationkey, min((CAST(s_suppkey % 3 AS VARCHAR), s_suppkey)) AS first FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY 1)
SELECT 'T' || s_nationkey AS title, CASE WHEN s_nationkey % 2 = 0 THEN 'inactive' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 2 = 0 THEN 100.0 ELSE round(100 * (0.3 + 7) / 8, 2) END AS score, c_custkey AS profile_id
  FROM n, (SELECT DISTINCT c_custkey % 4 AS c_custkey FROM customer)""")
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ingested, links of every second nation missing, and postings scored for profiles with and without the skills."""
    feed, nations = _feed(spark, sf_dir), v.read(spark, sf_dir, "nation")
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda n: _said("Skill", n.cast("string")))
    none = F.array().cast("array<string>")
    profiles = v.read(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("profile_id")).distinct().select(
        "profile_id", F.when(F.col("profile_id") % 2 == 0, everywhere).otherwise(none).alias("skills"),
        F.array().cast("array<struct<years:double,years_experience:double,duration_years:double,text:string>>").alias("experience"), none.alias("languages"),
    )
    preferences = spark.createDataFrame([], "profile_id long, preference_id int, is_current boolean, preferred_languages array<string>, locations array<string>, modalities array<string>, excluded_constraints array<string>, work_authorization array<string>, seniority string, wanted_min double, willing_to_relocate boolean, weights map<string,double>")
    links = nations.filter("n_nationkey % 2 = 1").select(_said("https://jobs.example/n/", F.col("n_nationkey").cast("string")).alias("url"))
    sources = spark.range(3).select(F.col("id").cast("string").alias("source"), F.col("id").alias("source_id"))
    seen = sources.select("source").crossJoin(links)  # three sources
    out = pipeline.run_all(feed, profiles, preferences, seen, sources, root=_folder(spark, "log"))
    made = out["evaluations"].join(out["jobs"].select("job_id", F.col("title").alias("t"), F.col("status").alias("s")), "job_id")
    return made.select(F.col("t").alias("title"), F.col("s").alias("status"), "score", "profile_id")


@query(f"""{_SCORES} SELECT job_id, k AS profile_id, CASE WHEN excluded THEN 0.0 ELSE raw END AS score FROM s WHERE lang <> 'en' OR k % 2 = 1""")
def new_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scoring run after one whose postings in English and even profiles have not changed."""
    postings, profiles, preferences = _scoring_inputs(spark, sf_dir)
    before = scoring.due_pairs(postings, profiles, preferences).filter((F.col("job_authorization")[0] == "en") & (F.col("profile_id") % 2 == 0))
    before = before.select(F.col("job_id").alias("evaluation_id"), "job_id", "profile_id", F.current_timestamp().alias("evaluated_at"), "fingerprint")
    return pipeline.run_scoring(postings, profiles, preferences, before).select("job_id", "profile_id", "score")


@query(f"""WITH {v.RUNS}, g AS (SELECT execution_id, sum(issues) AS issues, sum(scored) AS scored, count(*) AS runs FROM runs GROUP BY 1)
SELECT CASE WHEN issues > 0 AND scored = 0 THEN 'failed' WHEN issues > 0 THEN 'partial' ELSE 'success' END AS status, count(*) AS executions, count(*) AS ids, CAST(sum(runs) AS BIGINT) AS runs FROM g GROUP BY 1""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions and their source runs, appended to the log and read again."""
    root, lines = _folder(spark, "log"), v.runs(spark, sf_dir)
    tables.write_run_log(root, runs.execution_summary(lines), lines)
    executions, logged = tables.read_table(spark, root, "executions"), tables.read_table(spark, root, "source_runs")
    counted = logged.groupBy("execution_id").agg(F.count("*").alias("runs"))
    joined = executions.join(counted, "execution_id")
    return joined.groupBy("status").agg(F.count("*").alias("executions"), F.countDistinct("run_uuid").alias("ids"), F.sum("runs").alias("runs"))


@query(f"WITH {v.JOBS} SELECT job_id, title, status, region FROM jobs WHERE region IN ('usa', 'cdmx')")
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written by region and status; the filter prunes folders."""
    root = _folder(spark, "tables")
    tables.write_table(v.jobs(spark, sf_dir), root, "postings", mode="overwrite")
    return tables.read_table(spark, root, "postings").filter(F.col("region").isin("usa", "cdmx")).select("job_id", "title", "status", "region")


@query(f"""WITH u AS ({ORACLE_SQL["sanitize_pages"]}) SELECT * FROM u""")
def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql_functions(spark)
    v.read(spark, sf_dir, "pages").createOrReplaceTempView("some_pages")
    names = QUERIES["sanitize_pages"](spark, sf_dir).columns
    return spark.sql(f"SELECT page_id, posting_text(html) AS {next(c for c in names if c != 'page_id')} FROM some_pages")


@query(f"""WITH {v.DOC_POSTINGS}, f AS ({ORACLE_SQL["fingerprint_postings"]}) SELECT p.job_id, f.fingerprint, {REGION} AS region FROM doc_postings p JOIN f ON p.job_id = f.job_id""")
def sql_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql_functions(spark)
    v.doc_postings(spark, sf_dir).createOrReplaceTempView("some_postings")
    return spark.sql("SELECT job_id, posting_fingerprint(title, company, location) AS fingerprint, posting_region(location) AS region FROM some_postings")


@query("""SELECT 'p' || CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS source, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS title,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS company, p_type AS location, CASE WHEN p_partkey % 2 = 0 THEN 'remote' ELSE 'hybrid' END AS modality,
  count(*) AS items FROM part GROUP BY ALL""")
def aliased_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two adapters whose items have the same keys with other meanings, in one plan."""
    p = v.read(spark, sf_dir, "part")
    item = F.struct(F.col("p_name").alias("a"), F.col("p_brand").alias("b"), F.col("p_type").alias("c"), F.lit("hybrid").alias("d"), F.lit("remote").alias("e"), F.lit("/x").alias("url"))
    half, page = F.col("p_partkey") % 2, F.floor(F.col("p_partkey") / PAGE)
    raw = p.groupBy(half.alias("half"), page.alias("page")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    names = ("a company first", "a title first")
    meanings = ({"title": ("none", "b"), "company": ("a",), "location": ("c",), "modality": ("e",)}, {"title": ("a",), "company": ("b",), "location": ("c",), "modality": ("d",)})
    known = dict(tables._ADAPTERS)
    for name, aliases in zip(names, meanings, strict=True):
        tables.register_adapter(name, feeds.scan_items, "C", aliases)
    try:
        source = F.concat(F.lit("p"), F.col("half").cast("string"))
        adapter = F.when(F.col("half") == 0, names[0]).otherwise(names[1])
        routed = raw.select(source.alias("source"), adapter.alias("adapter"), F.lit("https://jobs.example/").alias("base_url"), F.lit("").alias("default_company"), "payload")
        found = feeds.normalize_items(tables.scan_routed(routed))
    finally:
        tables._ADAPTERS.clear()
        tables._ADAPTERS.update(known)
    return found.groupBy("source", "title", "company", "location", "modality").agg(F.count("*").alias("items"))


def _files(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark, "files")
    v.read(spark, sf_dir, "supplier").select("s_name").repartition(4, "s_name").write.text(folder)
    return folder


@query("SELECT s_name AS line, 'file' AS source FROM supplier UNION ALL SELECT n_name, 'inline' FROM nation UNION ALL SELECT s_name, 'by path' FROM supplier UNION ALL SELECT NULL, 'no file'")
def raw_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of files in subfolders whose names hold blanks, signs and accents, found by path and by name, and inline ones, which win over a file."""
    folder = _folder(spark, "files")
    kind = F.concat(F.lit("naïve + 50% of "), (F.col("s_suppkey") % 3).cast("string"))
    s = v.read(spark, sf_dir, "supplier")
    s.select("s_name", kind.alias("kind"), F.lit(1).alias("half")).repartition(3, "kind").write.partitionBy("half", "kind").text(folder)
    path = tables.file_below(spark, folder, F.col("_metadata.file_path"))
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(path.alias("path"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    one = files.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    paths = files.select(F.lit("by path").alias("source"), F.lit(None).cast("string").alias("payload"), F.col("path").alias("payload_path"))
    names = one.select(F.lit("file").alias("source"), F.lit(None).cast("string").alias("payload"), F.when(F.col("n") == 1, F.col("name")).otherwise(F.col("path")).alias("payload_path"))
    inline = v.read(spark, sf_dir, "nation").select(F.lit("inline").alias("source"), F.col("n_name").alias("payload"), F.lit("any").alias("payload_path"))
    lost = spark.range(1).select(F.lit("no file").alias("source"), F.lit(None).cast("string").alias("payload"), F.lit("no such file").alias("payload_path"))
    found = tables.load_raw(spark, paths.unionByName(names).unionByName(inline).unionByName(lost), folder)
    return found.select("source", F.explode_outer(F.split(F.rtrim("payload", F.lit("\n")), "\n")).alias("line"))


@query("SELECT s_name AS line, TRUE AS whole FROM supplier")
def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.scan_resume_files(spark, _files(spark, sf_dir))
    text = F.decode("content", "UTF-8")
    return files.select(F.explode(F.split(F.rtrim(text, F.lit("\n")), "\n")).alias("line"), (F.octet_length("content") == F.col("length")).alias("whole"))


@query("""SELECT conv_id AS id, count(*) FILTER (WHERE role <> 'user' AND trim(replace(text, chr(10), ' ')) <> '') AS experience_lines
  FROM conversations WHERE text IS NOT NULL GROUP BY 1 HAVING sum(length(trim(text))) >= 20""")
def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resume.build_profiles(_resumes(spark, sf_dir))
    return made.select("id", F.coalesce(F.size("experience"), F.lit(0)).cast("long").alias("experience_lines"))


@query(f"""WITH {_SOURCES}, a AS (SELECT k, adapter, CASE adapter WHEN 'greenhouse-career-page' THEN 'Greenhouse employer' WHEN 'lever-career-page' THEN 'Lever employer' END AS company FROM routed
  WHERE adapter IS NOT NULL AND adapter <> 'career-page')
SELECT adapter, company, count(*) AS items FROM a GROUP BY 1, 2""")
def adapted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier sources routed to the known adapters, each with one item, or a page with one card."""
    from jobloom.operators import policy

    extra = spark.createDataFrame([("career-page", None)], "adapter string, default_company string")  # known, but without a scan
    routed = policy.route_sources(_sources(spark, sf_dir), tables.adapter_names(spark).unionByName(extra))
    page = F.col("adapter").endswith("page")
    payload = F.when(~page, F.to_json(F.struct(F.array(F.struct(F.col("name").alias("title"))).alias("jobs"))))
    html = F.when(page, _said("<article><h1 class=title>", F.col("name"), "</h1></article>"))
    raw = routed.select(F.col("name").alias("source"), "adapter", "base_url", F.lit("").alias("default_company"), payload.alias("payload"), html.alias("html"))
    return tables.scan_routed(raw).groupBy("adapter", F.col("default_company").alias("company")).agg(F.count("*").alias("items"))


@query(f"""WITH {v.JOBS}, {v.EVALUATIONS} SELECT j.job_id, any_value(title) AS title, any_value(description) AS description, any_value(region) AS region,
  arg_max(e.score, (e.evaluated_at, e.evaluation_id)) AS latest_score, CAST(NULL AS VARCHAR) AS canonical_url, count(e.job_id) AS evaluations
  FROM jobs j LEFT JOIN evaluations e ON j.job_id = e.job_id GROUP BY 1""")
def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.job_detail_rows(listing.job_details(v.jobs(spark, sf_dir), v.evaluations(spark, sf_dir)))
    return rows.select("job_id", "title", "description", "region", "latest_score", "canonical_url", F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("evaluations"))


@query(f"""WITH {v.RUNS}, o AS (SELECT max(o_orderkey) AS execution_id FROM orders)
SELECT o.execution_id, count(run_id) AS runs FROM o LEFT JOIN runs ON o.execution_id = runs.execution_id GROUP BY 1""")
def execution_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by the run's id: here that of the newest order."""
    orders = v.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"), _said("run-", F.col("o_orderkey").cast("string")).alias("run_uuid"))
    newest = orders.agg(F.max_by("run_uuid", "execution_id")).first()[0]
    found = listing.execution_of_run(orders, v.runs(spark, sf_dir).select("execution_id", "run_id", "jobs_found"), newest)
    return found.select("execution_id", F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("runs"))
