import datetime
import json

import pytest
from pyspark.sql import functions as F

from jobloom.sources import cards, feeds, scratch, tables
from jobloom.streaming import ingest

SCHEMA = "source string, base_url string, default_company string, payload string"


def read(spark, payload, company=None, base="https://jobs.example/"):
    return feeds.read_feeds(spark.createDataFrame([("s", base, company, json.dumps(payload))], SCHEMA))


def test_general_feed(spark):
    jobs = [
        {"title": "Baker of night bread", "company": "Oven & Sons", "description": "<em>Knead</em>", "url": "/bakers/9?lot=3", "location": "Polanco, CDMX",
         "modality": "REMOTE", "salary": "from $1,250 to $2,400.50 MXN", "requirements": "Flour\n• Water;Salt", "date_posted": "2031-02-03"},
        {"title": "Gardener", "company": "Oven & Sons", "description": "d", "url": "/g", "apply_url": "/g/form", "location": "Tlaquepaque, Jalisco", "modality": "hybrid or remote"},
        {"title": "Diver", "company": "Oven & Sons", "description": "d", "url": "/d", "location": "Miami, USA", "workplace_type": "on-site"},
        {"title": "Cook", "company": "Oven & Sons", "description": "d", "url": "/c", "location": "Oslo"},
    ]
    good, bad = read(spark, {"jobs": jobs})
    rows = good.orderBy("item_idx").collect()
    assert bad.count() == 0 and [(r.region, r.modality) for r in rows] == [("cdmx", "remote"), ("guadalajara", "remote"), ("usa", "onsite"), ("other", "unknown")]
    first = rows[0]
    assert first.description_url == "https://jobs.example/bakers/9?lot=3" and first.description == "Knead"
    assert (first.salary_min, first.salary_max, first.salary_currency) == (1250.0, 2400.5, "MXN")
    assert first.requirements == ["Flour", "Water", "Salt"] and first.published_at == datetime.date(2031, 2, 3)
    assert rows[1].application_url == "https://jobs.example/g/form" and first.application_url is None


def test_provider_shapes(spark):
    good, _ = read(spark, {"jobs": [{"title": "T", "company_name": "C", "content": "x", "location": {"name": "Mérida, México"}, "absolute_url": "https://b.example/1", "first_published": "2029-12-30T23:00:00+02:00", "metadata": ["a"]}]})
    r = good.first()
    assert (r.company, r.region, r.application_url, r.canonical_url, r.published_at) == ("C", "mexico", None, "https://b.example/1", datetime.date(2029, 12, 30))
    assert r.metadata == {"source_adapter": "s", "requirements": "[]", "provider_metadata": '["a"]'}
    good, _ = read(spark, [{"text": "T", "descriptionPlain": "x", "categories": {"location": "USA"}, "hostedUrl": "https://l.example/1", "applyUrl": "https://l.example/1/apply", "workplaceType": "hybrid", "createdAt": 1735689600000}], company="Fallback")
    r = good.first()
    assert (r.title, r.company, r.location, r.modality, r.published_at) == ("T", "Fallback", "USA", "hybrid", datetime.date(2025, 1, 1))
    good, _ = read(spark, {"data": [{"title": "T", "company": "C", "jobUrl": "https://a.example/1", "descriptionHtml": "<li>Fold paper.</li><style>b{}</style>", "isRemote": True, "location": "México"}]})
    assert (good.first().description, good.first().region, good.first().modality) == ("Fold paper.", "mexico", "remote")
    good, _ = read(spark, [{"title": "T", "company": "C", "url": "/1", "requirements": ["a"], "metadata": {"requirements": "own", "n": 1}}])
    assert good.first().metadata == {"source_adapter": "s", "requirements": "own", "n": "1"}


def test_union_of_sources(spark):
    a, b = spark.createDataFrame([("a", 0)], "source string, item_idx int"), spark.createDataFrame([("b", 0, 1)], "source string, item_idx int, x int")
    assert feeds.union_sources(a, b).count() == 2


def test_bad_items_drop_no_others(spark):
    ok = {"title": "T", "company": "C", "description": "d", "url": "/1"}
    payload = [{"legal": {"x": 1}}, ok, {"legal": {}, "title": "no link"}, 5, {**ok, "salary_min": 9, "salary_max": 2}, {**ok, "company": None}, {**ok, "url": "//x"}]
    good, bad = read(spark, payload)
    assert good.count() == 1
    got = {r.item_idx: r.error for r in bad.collect()}
    assert set(got) == {2, 3, 4, 5, 6} and "object" in got[3] and "salary_min" in got[4] and "company" in got[5] and "description URL" in got[6]
    assert feeds.scan_json_feed(spark.createDataFrame([("s", "{}"), ("t", "[]"), ("u", "7"), ("v", None), ("w", "{")], "source string, payload string")).count() == 0


def test_payload_checks(spark):
    cases = {"{": "payload is not valid JSON", "[]": "payload must be an object", '{"jobs":[]}': "jobs must be a non-empty list",
             '{"jobs":[{"url":"u"},{"title":"t"}]}': "job 2 needs description_url or url", '{"data":[{"url":"u"}]}': None}
    df = spark.createDataFrame([(c,) for c in cases], "payload string")
    assert {r.payload: r.error for r in feeds.validate_payloads(df).collect()} == cases


def test_cards(spark):
    page = """<ul><li class="big job-card"><h3 class="role-title">Lamp <u>lost</u> lighter</h3><p class="description">Light &#233; &amp; go</p><noscript>no</noscript>
      <em class="location">Pier 4</em><a href="/lamps/1">read</a><a class="apply" href="/lamps/1/form">go</a></li></ul>
      <article data-job='true'><i data-field="title">Two</i><i data-field="salary">$9</i><a href="/2/form">Apply now</a><a href="/2">Details</a></article>
      <div data-job="true"><b class=title>gone</b><article><b class="position">Three</b><a href="/3"><b>Postular</b></a><a>no link</a></li><article class="x">open"""
    rows = cards.scan_cards(spark.createDataFrame([("p", page, 1), ("q", None, 1), ("r", "", 2)], "url string, html string, title int")).collect()
    assert [(r.title, r.card_idx, r.fields, r.url, r.application_url) for r in rows] == [
        (1, 0, {"title": "Lamp", "description": "Light é & go", "location": "Pier 4"}, "/lamps/1", "/lamps/1/form"),
        (1, 1, {"title": "Two", "salary": "$9"}, "/2", "/2/form"),
        (1, 2, {"title": "Three"}, None, "/3"),
    ]


def test_cards_become_postings(spark):
    page = '<article><h1 class="title">Lighter</h1><p data-field="company">Pier</p><p data-field="salary">$5 - $7 MXN</p><p data-field="modality">Remote</p><a href="l/1">more</a></article>'
    pages = spark.createDataFrame([("s", "https://jobs.example/x/", None, page + "<article><b class=title>no link</b></article>"), ("t", "https://jobs.example/", "Shop", None)], "source string, base_url string, default_company string, html string")
    feed = spark.createDataFrame([("u", "https://jobs.example/", None, json.dumps([{"title": "T", "company": "C", "url": "/1"}]), page)], f"{SCHEMA}, html string")
    good, bad = feeds.read_feeds(pages)
    r = good.first()
    assert (r.title, r.company, r.salary_min, r.salary_max, r.salary_currency, r.modality, r.description_url) == ("Lighter", "Pier", 5.0, 7.0, "MXN", "remote", "https://jobs.example/x/l/1")
    assert [(b.item_idx, b.error) for b in bad.collect()] == [(1, "invalid job: description URL is required; company is required")]
    assert [r.title for r in feeds.read_feeds(feed)[0].collect()] == ["T"]  # the payload wins over the page
    routed = pages.withColumn("payload", F.lit(None).cast("string")).withColumn("adapter", F.lit("lever-career-page"))
    assert {(r.source, r.default_company) for r in tables.scan_routed(routed).collect()} == {("s", "Lever employer")}


def test_tables_and_mirror_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, "cdmx", "active"), (2, "usa", "inactive")], "job_id int, region string, status string")
    tables.write_table(df, str(tmp_path), "postings")
    assert tables.read_table(spark, str(tmp_path), "postings").filter("region = 'usa'").count() == 1
    tables.write_run_log(str(tmp_path), spark.range(1), spark.range(2))
    assert tables.read_table(spark, str(tmp_path), "executions").first().run_uuid
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text("from file")
    got = tables.load_raw(spark, spark.createDataFrame([("x", None, "a.json"), ("y", "inline", "a.json")], "source string, payload string, payload_path string"), str(tmp_path / "raw"))
    assert {r.source: r.payload for r in got.collect()} == {"x": "from file", "y": "inline"}
    assert tables.scan_resume_files(spark, str(tmp_path / "raw")).first().length == 9
    page = {"id": "p1", "properties": {"Title": {"title": [{"plain_text": "De"}, {"plain_text": "v"}]}, "Region": {"select": {"name": "cdmx"}}, "Published": {"date": {"start": "2026-01-01"}}, "Salary min": {"number": 5}, "Fingerprint": {"rich_text": [{"text": {"content": "f"}}]}, "Company": {"rich_text": []}}}
    r = tables.scan_mirror_pages(spark.createDataFrame([(json.dumps(page),)], "json string")).first()
    assert (r.page_id, r.Title, r.Region, r.Published, r["Salary min"], r.Fingerprint, r.Company) == ("p1", "Dev", "cdmx", "2026-01-01", "5", "f", None)
    tables.register_adapter("cards", cards.card_items, "Company")
    assert tables.adapter("cards") == (cards.card_items, "Company", None) and tables.adapter_names(spark).count() == 4
    del tables._ADAPTERS["cards"]


def test_incremental_ingestion(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def put(name, link):
        item = {"title": "T", "company": "C", "description": "d", "url": link}
        (folder / name).write_text(json.dumps({"source": "s", "base_url": "https://j.example", "payload": json.dumps([item])}))

    def store(good, bad, number):
        seen.extend(r.description_url for r in good.collect())

    put("1.json", "/1")
    ingest.ingest_feeds(spark, str(folder), str(tmp_path / "ck"), store)
    ingest.ingest_feeds(spark, str(folder), str(tmp_path / "ck"), store)
    put("2.json", "/2")
    ingest.ingest_feeds(spark, str(folder), str(tmp_path / "ck"), store)
    assert seen == ["https://j.example/1", "https://j.example/2"]


def test_incremental_upsert(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def put(name, link, text):
        item = {"title": "T", "company": "C", "description": text, "url": link}
        (folder / name).write_text(json.dumps({"source": "s", "base_url": "https://j.example", "payload": json.dumps([item, 5])}))

    put("1.json", "/1", "one")
    ingest.ingest_into(spark, str(folder), str(tmp_path / "ck"), root)
    ingest.ingest_into(spark, str(folder), str(tmp_path / "ck"), root)
    put("2.json", "/1?ref=x", "two")
    ingest.ingest_into(spark, str(folder), str(tmp_path / "ck"), root)
    (row,) = ingest.posting_ledger(spark, root).postings().collect()
    assert (row.description, row.sightings, row.status, row.metadata["source_adapter"]) == ("two", 2, "active", "s")
    assert spark.read.parquet(f"{root}/quarantine").count() == 2


def test_streaming_duplicates(spark, tmp_path):
    rows = [("2026-01-01 00:00:00", "https://j.example/1?ref=a"), ("2026-01-01 00:01:00", "https://j.example/1#x"), ("2026-01-01 00:02:00", "https://j.example/2")]
    df = spark.createDataFrame(rows, "detected_at string, url string").withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = ingest.suppress_duplicates(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.canonical_url for r in spark.table("kept").collect()) == ["https://j.example/1", "https://j.example/2"]


def test_files_by_path_and_name(spark, tmp_path):
    for path, text in (("my file.txt", "blank"), ("a+b%20.txt", "signs"), ("é/ñ.txt", "accents"), ("one/same.txt", "first"), ("two/same.txt", "second"), ("deep/er/only.txt", "only")):
        (tmp_path / "in put" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in put" / path).write_text(text)
    asked = ["my file.txt", "a+b%20.txt", "é/ñ.txt", "ñ.txt", "one/same.txt", "two/same.txt", "same.txt", "only.txt", "no.txt", None]
    rows = spark.createDataFrame([(str(k), None, path) for k, path in enumerate(asked)] + [("x", "inline", "my file.txt")], "source string, payload string, payload_path string")
    got = {r.source: r.payload for r in tables.load_raw(spark, rows, str(tmp_path / "in put")).collect()}
    assert [got[str(k)] for k in range(10)] == ["blank", "signs", "accents", "accents", "first", "second", None, "only", None, None] and got["x"] == "inline"


def test_aliases_of_adapters(spark):
    tables.register_adapter("swapped", feeds.scan_items, "C", {"title": ("", "company"), "company": ("title",), "location": ("town",), "modality": ("where",)})
    try:
        item = {"title": "A", "company": "B", "town": " X ", "where": "hybrid", "url": "/1"}
        raw = [(s, a, "https://j.example", "", json.dumps([item])) for s, a in (("s", "swapped"), ("t", "json-api-feed"))]
        routed = spark.createDataFrame(raw, "source string, adapter string, base_url string, default_company string, payload string")
        good, _ = feeds.validate_postings(feeds.normalize_items(tables.scan_routed(routed)))
        assert {(r.source, r.title, r.company, r.location, r.modality) for r in good.collect()} == {("s", "B", "A", "X", "hybrid"), ("t", "A", "B", None, "unknown")}
    finally:
        del tables._ADAPTERS["swapped"]
    with pytest.raises(ValueError, match="unknown fields: nothing"):
        tables.register_adapter("x", feeds.scan_items, None, {"nothing": ("a",)})


def test_cards_are_dealt_over_all_tasks_and_read_each_tag_once(spark):
    from jobloom.plans.ingestion import _card_pages
    from jobloom.sources.cards import cards_sql

    assert _card_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert cards_sql("html").count("regexp_") < 25  # what lambdas repeat, each card pays for
    page = "<article class=\"job-card\"><b class=\"x Title 'a'\">A &lt;B&gt;</b><i data-field='pay'>9 &#8364;</i><a href=\"\">none</a><a href='/x\"y'>more</a><a class=APPLY href=/z>go <b>on</b></a></article>"
    got = cards.scan_cards(spark.createDataFrame([(page,)], "html string")).first()
    assert (got.fields, got.url, got.application_url) == ({"title": "A <B>", "pay": "9 €"}, "/x\"y", "/z")


def test_a_text_of_zero_is_a_value_and_a_number_is_none(spark):
    given = [("0.0", 0.0), (0, 7.0), (False, 7.0), ("", 7.0), ([], 7.0), ("12", 12.0)]
    jobs = [{"title": "T", "company": "C", "url": "/x", "salary_min": x, "salaryMin": 7} for x, _ in given]
    for aliases in (None, F.create_map(F.lit("salary_min"), F.array(F.lit("salary_min"), F.lit("salaryMin")))):
        raw = spark.createDataFrame([("s", "https://jobs.example", "", json.dumps(jobs))], "source string, base_url string, default_company string, payload string")
        good, _ = feeds.read_feeds(raw if aliases is None else raw.withColumn("aliases", aliases))
        assert [r.salary_min for r in good.orderBy("item_idx").collect()] == [x for _, x in given]


def test_tables_of_numbers_are_as_large_in_a_file_as_in_memory(spark):
    """The planner broadcasts by a file's bytes: a table of numbers that repeat was some kilobytes to it."""
    rows = 1_500_000
    table = scratch.materialize(spark.range(rows).selectExpr("id % 3 as a", "struct(7L as b, true as c) as s"), "numbers")
    other = scratch.materialize(spark.range(rows).selectExpr("id as a", "id as d"), "others")
    for side in (table, other):
        assert side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 16 * rows
    joined = table.join(other, "a")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == rows
    texts = spark.range(5).selectExpr("id", "cast(id as string) as text", "array(1L) as many")
    assert sorted(map(tuple, scratch.materialize(texts, "texts").collect())) == [(k, str(k), [1]) for k in range(5)]
