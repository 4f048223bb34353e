import datetime
import json

import pytest
from pyspark.sql import functions as F

from jobloom.operators import history, identity, listing, pipeline, policy, reconcile, resume, runs, scoring

POSTING = "job_id int, title string, location string, region string, modality string, salary_max double, required_skills array<string>, desirable_skills array<string>, constraints array<string>, job_authorization array<string>, required_years double, job_seniority string"
PROFILE = "profile_id int, skills array<string>, experience array<struct<years:double,years_experience:double,duration_years:double,text:string>>, languages array<string>"
PREFERENCE = "profile_id int, preference_id int, is_current boolean, preferred_languages array<string>, locations array<string>, modalities array<string>, excluded_constraints array<string>, work_authorization array<string>, seniority string, wanted_min double, willing_to_relocate boolean, weights map<string,double>"


def pairs(spark, years=4.0, constraints=(), weights=None, skills=("Python", "FastAPI")):
    job = (1, "Dev", "CDMX", "cdmx", "remote", 70000.0, ["Python", "SQL"], ["FastAPI"], list(constraints), [], 3.0, "senior")
    person = (1, list(skills), [(years, None, None, None)], ["English"])
    wish = (1, 1, True, ["English", "Spanish"], ["CDMX"], ["remote"], ["relocation_required"], [], "senior", 50000.0, False, weights or {"skills": 2.0, "experience": 1.0})
    old = (1, 0, False, [], [], [], [], [], None, None, False, {})
    return scoring.pair(spark.createDataFrame([job], POSTING), spark.createDataFrame([person], PROFILE), spark.createDataFrame([wish, old], PREFERENCE))


def test_score_of_the_base_case(spark):
    r = scoring.score(pairs(spark)).first()
    assert (r.score, r.matches, r.gaps, r.recommendations, r.exclusions) == (86.67, ["fastapi", "python"], ["sql"], ["Close gap: sql"], [])
    assert r.breakdown.skills.match == 0.65 and r.breakdown.language.match == 0.5 and r.breakdown.required.gaps == ["sql"]


def test_score_variants(spark):
    assert scoring.score(pairs(spark, years=1.0)).first().breakdown.experience.match == 0.3333
    excluded = scoring.score(pairs(spark, constraints=["Relocation_Required"])).first()
    assert excluded.score == 0 and excluded.exclusions == ["relocation_required"] and excluded.breakdown.skills.match == 0.65
    assert scoring.score(pairs(spark, weights={"skills": 10.0, "experience": 0.0})).first().score != 86.67
    assert scoring.score(pairs(spark, weights={"skills": -5.0})).first().breakdown.skills.weight == 1.0
    assert scoring.score(pairs(spark), override={"skills": 0.0}).first().breakdown.skills.weight == 0
    zero = scoring.score(pairs(spark), override=dict.fromkeys(scoring.DIMENSIONS, 0)).first()
    assert zero.score == 0
    assert 0 <= scoring.score(pairs(spark, skills=())).first().score <= 100


def test_reevaluation(spark):
    p = pairs(spark)
    inputs = ["skills", "title"]
    done = p.select("job_id", "profile_id", scoring.input_fingerprint(inputs).alias("fingerprint"))
    assert scoring.needs_evaluation(p, done, inputs).count() == 0
    assert scoring.needs_evaluation(p, done, inputs, model="other").count() == 1
    assert scoring.needs_evaluation(p, done.limit(0), inputs).count() == 1
    assert scoring.needs_evaluation(p.withColumn("title", F.lit("x")), done, inputs).count() == 1
    assert scoring.bounded_evaluation(p, 0).count() == 0


def test_survivorship_and_snapshots(spark):
    rows = [
        (1, "https://j.example/1", "f1", "Dev", "first", "remote", "u", None, None),
        (2, "https://j.example/1", "f1", "Dev", "", "unknown", "u", None, 5),
        (3, "https://j.example/2", "f1", "Dev", "second", "other", "u", None, 6),
        (4, "https://j.example/2", "f2", "Dev", "second", None, "u", None, 7),
        (5, "https://j.example/9", "f9", "Ops", "x", None, "v", None, None),
    ]
    df = spark.createDataFrame(rows, "seq int, canonical_url string, fingerprint string, title string, description string, modality string, description_url string, application_url string, source_id int")
    found = identity.identity_components(df)
    assert {r.seq: r.identity for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    merged = {r.identity: r for r in identity.merge_postings(found, ["description", "modality"]).collect()}
    assert (merged[1].description, merged[1].modality, merged[1].source_id, merged[1].sightings) == ("second", "remote", 5, 4)
    past = identity.snapshots(found).collect()
    assert [(r.identity, r.description, r.replaced_at) for r in past] == [(1, "first", 3)]
    maps = spark.createDataFrame([(1, 1, {"a": "1", "b": "1"}), (1, 2, {"b": "2"})], "identity int, seq int, m map<string,string>")
    assert identity.merge_metadata(maps, "m").first().m == {"a": "1", "b": "2"}


def test_conflicting_identity(spark):
    old = spark.createDataFrame([(1, "u1", "f1"), (2, "u2", "f2")], "job_id int, canonical_url string, fingerprint string")
    new = spark.createDataFrame([("u1", "f2"), ("u9", "f1"), ("u9", "f9")], "canonical_url string, fingerprint string")
    got = {(r.canonical_url, r.fingerprint): (r.job_id, r.identity_conflict) for r in identity.resolve_identity(new, old).collect()}
    assert got == {("u1", "f2"): (1, True), ("u9", "f1"): (1, False), ("u9", "f9"): (None, False)}
    # Stored rows may repeat a fingerprint: an incoming row stays one row.
    twice = old.unionByName(old.selectExpr("job_id + 10 as job_id", "'u3' as canonical_url", "fingerprint"))
    assert [r.job_id for r in identity.resolve_identity(new.filter("fingerprint = 'f1'"), twice).collect()] == [1]
    runs_of = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b")], "job_id int, seq int, x string")
    assert sorted(tuple(r) for r in identity.dedup_run(runs_of).collect()) == [(1, 3, "c", 1), (2, 2, "b", 2)]


def test_listing_rules(spark):
    jobs = spark.createDataFrame(
        [(1, "Rye Baker", "a", "d", "cdmx", "remote", "active", 1), (2, "Data Gardener", "b", "d", "guadalajara", "hybrid", "active", 2), (3, "Diver", "c", "d", "usa", "onsite", "active", 3)],
        "job_id int, title string, company string, description string, region string, modality string, status string, detected_at int",
    )
    at = datetime.datetime(2026, 1, 1)
    evals = spark.createDataFrame([(k, k, 1, s, at) for k, s in ((1, 92.0), (2, 72.0), (3, 55.0))], "evaluation_id int, job_id int, profile_id int, score double, evaluated_at timestamp")
    page, totals = listing.list_jobs(jobs, evals, profile_id=1, region="CDMX")
    assert [r.title for r in page.collect()] == ["Rye Baker"] and tuple(totals.first()) == (1, 1)
    page, _ = listing.list_jobs(jobs, evals, profile_id=1, min_score=70, q="data")
    assert [r.title for r in page.collect()] == ["Data Gardener"]
    page, _ = listing.list_jobs(jobs, evals, profile_id=2, sort="score")
    assert [r.score for r in page.collect()] == [None] * 3
    for bad in ({"page": 0}, {"size": 101}, {"sort": "id"}, {"min_score": 101}, {"modality": "moon"}):
        with pytest.raises(ValueError):
            listing.list_jobs(jobs, evals, **bad)
    assert listing.job_details(jobs, evals).filter("job_id = 1").first().latest_score == 92.0


def test_runs(spark):
    items = spark.createDataFrame([("a", 0, True, None), ("a", 1, False, "bad"), ("b", 0, True, None)], "source string, item_idx int, ok boolean, error string")
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    got = {r.source: (r.jobs_found, r.status, r.message) for r in runs.source_runs(items, sources).collect()}
    assert got == {"a": (1, "partial", "bad"), "b": (1, "success", None), "c": (0, "failed", "No jobs found for c")}
    with pytest.raises(ValueError):
        runs.execution_summary(items, "other")


def test_versions(spark):
    rows = [(1, 1, "x", None), (1, 2, "x", None), (1, 3, None, "es"), (1, 4, "y", "es")]
    got = history.profile_versions(spark.createDataFrame(rows, "profile_id int, seq int, skills string, languages string"), ["skills", "languages"])
    assert [(r.version, r.changed_dimensions) for r in got.orderBy("seq").collect()] == [(2, ["skills"]), (2, []), (3, ["languages"]), (4, ["skills"])]
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, y int")
    patches = spark.createDataFrame([(1, None, 7, ["x"]), (1, "z", 7, ["y"]), (9, "q", 1, ["x"])], "id int, x string, y int, given array<string>")
    assert sorted(tuple(r) for r in history.apply_patches(rows, patches.drop("given"), "id").collect()) == [(1, "z", 7), (2, "b", 6)]
    assert sorted(tuple(r) for r in history.apply_patches(rows, patches.limit(1), "id", "given").collect()) == [(1, None, 5), (2, "b", 6)]
    with pytest.raises(ValueError, match="unknown fields: z"):
        history.apply_patches(spark.range(1), spark.range(1).selectExpr("id", "1 as z"), "id")


def test_reconcile(spark):
    local = spark.createDataFrame([(1, "f1", "A"), (2, "f2", "B"), (3, "f3", "C")], "job_id int, fingerprint string, title string")
    pages = spark.createDataFrame([(11, "f1", "1", "A"), (12, None, "2", "b"), (13, "gone", None, "x")], "page_id long, fingerprint string, local_id string, title string")
    diffs = reconcile.reconcile(local.withColumn("job_id", F.col("job_id").cast("long")), pages, ["title"])
    got = {(r.kind, r.job_id, r.page_id): [tuple(d) for d in r.fields] for r in diffs.collect()}
    assert got == {("missing", 3, None): [], ("stale", 2, 12): [("title", "B", "b")], ("orphan", None, 13): []}
    assert tuple(reconcile.reconcile_summary(diffs, pages).first()) == (3, 2, 1, "drift")
    outcomes = spark.createDataFrame([(2, True), (3, False)], "job_id long, ok boolean")
    plan = reconcile.repair_plan(diffs, local.filter("job_id < 3"), outcomes)
    assert {r.kind: (r.result, r.error) for r in plan.collect()} == {"missing": ("failed", "local_job_not_found"), "stale": ("repaired", None), "orphan": ("skipped", None)}
    assert reconcile.repair_state(plan).first().state == "repair_failed"
    assert len(reconcile.to_mirror_rows(local).columns) == 25


def test_resume(spark):
    lines = "Mara Quill\nBakes with python\nSkills\nPython, FastAPI, SQL, Go-karts\nExperience\nRan an oven\nEducation\nSchool of bread\nLanguages\nEnglish, Spanish"
    r = resume.build_profiles(spark.createDataFrame([(1, lines), (2, "short"), (3, None)], "id int, text string")).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.name, r.summary) == ("Mara Quill", "Mara Quill Bakes with python")
    assert {"python", "fastapi", "sql"} <= set(r.skills) and "Go-karts" in r.skills and "Python" not in r.skills
    assert (r.experience, r.languages, r.education) == (["Ran an oven"], ["English, Spanish"], ["School of bread"])
    files = spark.createDataFrame(
        [("a.pdf", "application/pdf", bytearray(b"%PDF-1")), ("a.pdf", None, bytearray(b"zip")), ("a.txt", None, bytearray(b"x")), ("x/a.pdf", None, bytearray(b"%PDF-")), ("a.docx", "application/pdf", bytearray(b"x")), ("a.pdf", None, bytearray())],
        "name string, mime string, content binary",
    )
    assert [r.error for r in resume.validate_resume_files(files).collect()] == [None, "not a PDF file", "unsupported file type", "invalid file name", "file type does not match", "empty file"]


def test_routing_and_source_checks(spark):
    adapters = spark.createDataFrame([("json-api-feed",), ("greenhouse-career-page",), ("lever-career-page",), ("acme",)], "adapter string")
    rows = [
        ("acme", "career_page", None, None, None, "acme"), ("s1", "api", None, None, None, "json-api-feed"),
        ("s2", "career_page", "https://boards.greenhouse.io/x", None, None, "greenhouse-career-page"),
        ("s3", "career_page", "https://notgreenhouse.io/x", None, None, None), ("s4", "api", None, None, "nope", None),
        ("s5", "career_page", None, "Lever", None, "lever-career-page"), ("s6", "x", None, None, "acme", "acme"),
    ]
    sources = spark.createDataFrame([r[:5] for r in rows], "name string, kind string, base_url string, provider string, adapter_override string")
    routed = policy.route_sources(sources, adapters)
    assert {r.name: r.adapter for r in routed.collect()} == {r[0]: r[5] for r in rows}
    checked = policy.validate_sources(routed.filter("name in ('s1', 's3', 's4')").withColumns({
        "terms_url": F.lit("ftp://x"), "terms_accepted": F.col("name") == "s1",
        "config": F.when(F.col("name") == "s1", F.create_map(F.lit("payload"), F.lit("{}"))).otherwise(F.create_map(F.lit("allow_network"), F.lit("maybe"))),
    }))
    got = {r.name: [x.field for x in r.violations] for r in checked.collect()}
    assert got == {"s1": ["terms_url"], "s3": ["terms_url", "config.allow_network", "terms_accepted", "config.adapter"], "s4": ["terms_url", "config.allow_network", "terms_accepted", "config.adapter"]}


def test_source_limits(spark):
    kind = "name string, kind string, base_url string, provider string, adapter string, terms_url string, terms_accepted boolean, config map<string,string>"
    row = ("s", "api", None, None, "json-api-feed", None, True, {"payload": "{}"})
    for limits, fields in (((0.0, 1, 0), ["timeout_seconds"]), ((1.0, 0, -1), ["requests_per_minute", "max_retries"]), ((1.0, 1, 0), [])):
        df = spark.createDataFrame([(*row, *limits)], f"{kind}, timeout_seconds double, requests_per_minute int, max_retries int")
        assert [x.field for x in policy.validate_sources(df).first().violations] == fields


def test_crawl_policy(spark):
    urls = spark.createDataFrame([(f"https://{h}/lamps/lighter",) for h in ("a.x", "b.x", "c.x", "d.x", "e.x", "f.x")], "url string")
    rules = spark.createDataFrame([("a.x", "/", False), ("a.x", "/lamps/", True), ("b.x", "/lamps/", False), ("f.x", "/lamps/", False), ("f.x", "/lamps/", True)], "host string, prefix string, allow boolean")
    hosts = spark.createDataFrame([("a.x", 200), ("b.x", 200), ("c.x", 404), ("d.x", 403), ("e.x", 503), ("f.x", 200)], "host string, status int")
    got = {r.host: r.verdict for r in policy.apply_crawl_policy(urls, rules, hosts).collect()}
    assert got == {"a.x": "allowed", "b.x": "denied", "c.x": "allowed", "d.x": "denied", "e.x": "unverifiable", "f.x": "allowed"}


def feed(spark, *payloads):
    return spark.createDataFrame([(f"s{k}", "https://jobs.example", "Acme", p) for k, p in enumerate(payloads)], "source string, base_url string, default_company string, payload string")


GOOD = '{"title":"Dev","url":"/1","location":"CDMX","description":"x"}'


def test_ingest_is_idempotent(spark):
    raw = feed(spark, f'{{"jobs":[{GOOD},{{"title":"no link"}}]}}', f"[{GOOD}]", "broken")
    out = pipeline.run_ingest(raw)
    assert out["postings"].count() == 1 and out["postings"].first().sightings == 2 and out["snapshots"].count() == 0
    assert {r.source: r.status for r in out["source_runs"].collect()} == {"s0": "partial", "s1": "success", "s2": "failed"}
    assert out["quarantine"].first().error == "invalid job: description URL is required"
    again = pipeline.run_ingest(raw, out["sightings"])["postings"]
    assert again.count() == 1 and again.first().sightings == 4
    # Stored numbers sort as numbers: 10 comes after 9.
    held = out["sightings"].limit(1).withColumn("seq", F.explode(F.array(F.lit(9), F.lit(10)))).withColumn("description", F.concat(F.lit("text "), "seq"))
    assert pipeline.run_ingest(feed(spark, "[]"), held)["postings"].first().description == "text 10"
    assert pipeline.run_ingest(feed(spark, f"[{GOOD},{GOOD}]"), per_source_cap=1)["postings"].first().sightings == 1


def test_items_of_many_pages_of_a_source(spark):
    """Positions are counted within a payload: pages go by their number, and without one they are still told apart."""
    pages = [[(k, j) for j in range(3)] for k in range(12)]
    item = '{{"title":"T{1}","url":"/{1}","description":"page {0}"}}'
    rows = [("s", "https://jobs.example", "Acme", "[" + ",".join(item.format(k, j) for k, j in page) + ',{"title":"bad"}]', k) for k, page in enumerate(pages)]
    raw = spark.createDataFrame(rows, "source string, base_url string, default_company string, payload string, page long").repartition(5)
    out = pipeline.run_ingest(raw)
    assert {(r.title, r.sightings, r.description) for r in out["postings"].collect()} == {(f"T{j}", 12, "page 11") for j in range(3)}
    assert out["source_runs"].first().errors == 12 and out["quarantine"].distinct().count() == 12
    two = {(r.title, r.sightings, r.description) for r in pipeline.run_ingest(raw, out["sightings"])["postings"].collect()}
    assert two == {(f"T{j}", 24, "page 11") for j in range(3)}
    capped = {(r.title, r.description) for r in pipeline.run_ingest(raw, per_source_cap=5)["sightings"].collect()}
    assert capped == {("T0", "page 0"), ("T1", "page 0"), ("T2", "page 0"), ("T0", "page 1"), ("T1", "page 1")}
    bare = pipeline.run_ingest(raw.drop("page"))
    assert {(r.title, r.sightings) for r in bare["postings"].collect()} == {(f"T{j}", 12) for j in range(3)}


def test_full_run(spark, tmp_path):
    item = '{"title":"Dev","url":"/1","location":"CDMX","description":"x","metadata":{"required_skills":["Python","SQL"],"constraints":"nights"}}'
    person = spark.createDataFrame([(1, ["python"], [], ["English"])], PROFILE)
    wish = spark.createDataFrame([(1, 1, True, [], [], [], [], [], None, None, False, {})], PREFERENCE)
    sources = spark.createDataFrame([("s0", 7)], "source string, source_id int")
    seen = spark.createDataFrame([("s0", "https://jobs.example/1?ref=x")], "source string, url string")
    out = pipeline.run_all(feed(spark, f"[{item}]"), person, wish, seen, sources, root=str(tmp_path))
    job = out["jobs"].first()
    assert (job.status, job.source_id, job.marked) == ("active", 7, False) and out["summary"].first().status == "success"
    made = out["evaluations"].first()
    assert made.gaps == ["sql"] and made.breakdown.skills.match == 0.65
    page = out["mirror"].first()
    assert page["Compatibility score"] == made.score and page["Gaps"] == "sql" and page["Canonical URL"] == "https://jobs.example/1"
    assert spark.read.parquet(f"{tmp_path}/executions").first().run_uuid and spark.read.parquet(f"{tmp_path}/source_runs").count() == 1
    gone = pipeline.run_all(feed(spark, f"[{item}]"), person, wish, seen.withColumn("url", F.lit("https://jobs.example/2")), sources)
    assert gone["jobs"].first().status == "inactive"
    strict = wish.withColumn("excluded_constraints", F.array(F.lit("nights")))
    assert pipeline.run_all(feed(spark, f"[{item}]"), person, strict, seen, sources)["evaluations"].first().score == 0


def test_digest_of_a_source_with_very_many_errors(spark):
    items = spark.range(5000).selectExpr("'a' AS source", "id AS item_idx", "false AS ok", "IF(id < 3000, '', 'late') AS error")
    items = items.unionByName(spark.createDataFrame([("b", 2, False, "two"), ("b", 1, False, "one"), ("b", 3, True, None)], "source string, item_idx long, ok boolean, error string"))
    assert runs.first_messages(items).groupBy("source").count().orderBy("source").collect() == [("a", 1001), ("b", 2)]
    got = {r.source: r for r in runs.source_runs(items, items.select("source").distinct()).collect()}
    assert got["a"].message == "; " * 1000 and got["a"].errors == 5000
    assert (got["b"].message, got["b"].errors, got["b"].jobs_found) == ("one; two", 2, 1)


def test_borrowed_crawl_rules(spark):
    urls = spark.createDataFrame([(f"https://{h}/lamps/lighter",) for h in ("api.a", "api.b", "api.c", "api.d", "api.e", "A.x")], "url string")
    rules = spark.createDataFrame([("a.x", "/lamps/", False), ("a.x", "/lamps/lighter", True), ("b.x", "/", False), ("api.d", "/", True)], "host string, prefix string, allow boolean")
    hosts = spark.createDataFrame(
        [("api.a", 401), ("api.b", 401), ("api.c", 401), ("api.d", 403), ("api.e", 401), ("a.x", 200), ("b.x", 200), ("c.x", 404), ("e.x", 401)], "host string, status int"
    )
    lent = [("API.a", 401, "A.x"), ("api.b", 401, "b.x"), ("api.c", 401, "c.x"), ("api.d", 401, "a.x"), ("api.e", 401, "e.x"), ("e.x", 401, "a.x"), ("a.x", 401, "b.x")]
    lenders = spark.createDataFrame(lent, "host string, status int, lender string")
    got = {r.host: (r.verdict, r.rules_of, r.rule) for r in policy.apply_crawl_policy(urls, rules, hosts, lenders).collect()}
    assert got == {
        "api.a": ("allowed", "a.x", "/lamps/lighter"), "api.b": ("denied", "b.x", "/"), "api.c": ("unverifiable", "c.x", None),
        "api.d": ("denied", "api.d", None), "api.e": ("allowed", "a.x", "/lamps/lighter"), "a.x": ("allowed", "a.x", "/lamps/lighter"),
    }
    assert {r.verdict for r in policy.apply_crawl_policy(urls, rules, hosts).filter("host like 'api%'").collect()} == {"denied"}


def test_a_run_continues_the_one_before(spark):
    """Ids, status and the time of detection stay, and only what has changed is scored again."""
    item = '{"title":"Dev","url":"/1","location":"CDMX","description":"x","requirements":["a","b"],"salary_period":"Month","metadata":{"required_skills":["Python"]}}'
    other = '{"title":"Ops","url":"/2","location":"CDMX","description":"y"}'
    person = spark.createDataFrame([(1, ["python"], [], ["English"])], PROFILE)
    wish = spark.createDataFrame([(1, 1, True, [], [], [], [], [], None, None, False, {})], PREFERENCE)
    sources = spark.createDataFrame([("s0", 7)], "source string, source_id int")
    seen = spark.createDataFrame([("s0", "https://jobs.example/1")], "source string, url string")
    one = pipeline.run_all(feed(spark, f"[{item},{other}]"), person, wish, seen, sources)
    status = {r.title: r.status for r in one["jobs"].collect()}
    assert status == {"Dev": "active", "Ops": "inactive"} and one["evaluations"].count() == 2
    page = {r.Title: r for r in one["mirror"].collect()}["Dev"]
    assert page["Requirements"] == "a, b" and page["Salary period"] == "month" and page["Score explanation"].startswith("skills: ") and page["Detected"] and page["Checked"]
    both = seen.unionByName(spark.createDataFrame([("s0", "https://jobs.example/2")], "source string, url string"))
    held = {"stored": one["sightings"], "before": one["jobs"], "earlier": one["all_evaluations"]}
    two = pipeline.run_all(feed(spark, f"[{item},{other}]"), person, wish, both, sources, **held)
    assert {r.title: (r.job_id, r.status) for r in two["jobs"].collect()} == {r.title: (r.job_id, r.status) for r in one["jobs"].collect()}
    assert two["evaluations"].count() == 0 and two["mirror"].count() == 2 and two["mirror"].filter("`Compatibility score` is null").count() == 0
    changed = item.replace('"Python"', '"Rust"')
    three = pipeline.run_all(feed(spark, f"[{changed},{other}]"), person, wish, both, sources, **held, reactivate=True)
    assert {r.title: r.status for r in three["jobs"].collect()} == {"Dev": "active", "Ops": "active"}
    assert [r.gaps for r in three["evaluations"].collect()] == [["rust"]] and three["mirror"].count() == 2


def test_a_payload_with_the_text_of_its_posting_made_before(spark):
    rows = [(1, 7, None, "Acme", 'say "é"\n<b>' * 2000, None, "usa", None, [], None, "English", "x")]
    pairs = spark.createDataFrame(
        rows, "job_id int, profile_id int, title string, company string, description string, location string, region string, modality string, skills array<string>, locations array<string>, language string, seniority string"
    ).withColumns({"languages": F.array("language"), "modalities": F.array("language"), "experience": F.expr("array(named_struct('years', 1.5D, 'years_experience', CAST(NULL AS DOUBLE), 'duration_years', CAST(NULL AS DOUBLE)), NULL)")})
    whole = listing.safe_payload(pairs).first().payload
    made = pairs.withColumn("safe_job", listing.safe_job()).drop("title", "company", "description")
    assert listing.safe_payload(made).first().payload == whole
    assert json.loads(whole) == {
        "profile": {"skills": [], "experience": [{"years": 1.5}, {}], "languages": ["English"], "preferences": {"locations": [], "modalities": ["English"], "seniority": "x"}},
        "job": {"title": "", "company": "Acme", "description": ('say "é"\n<b>' * 2000)[:12000], "location": "", "region": "usa", "modality": "unknown"},
    }


def test_keys_of_sightings_are_made_once(spark):
    """What the rows cost is counted: by the rows that pass, not by the joins that read them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(100).selectExpr("id AS seq", "concat('u', id div 4) AS canonical_url", "concat('f', id div 6) AS fingerprint")
    found = identity.identity_components(rows.mapInArrow(counted, rows.schema)).select("seq", "identity").collect()
    assert {r.seq // 12 * 12 == r.identity for r in found} == {True} and len(found) == 100
    assert made.value <= 200  # for the keys, and for the result
