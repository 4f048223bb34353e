import datetime
import json

import pytest
from pyspark.sql import functions as F

from jobloom.functions import fields, links, sql, text


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Shop.EXAMPLE:443/bread///rye/?z=1&UTM_campaign=k&c=3#crust": "https://shop.example/bread/rye?c=3&z=1",
        "https://shop.example/bread/rye?gclid=7&z=1": "https://shop.example/bread/rye?z=1",
        "http://u:p@h.example:8080/?REF=x&q=a+b&e=": "http://h.example:8080/?e=&q=a+b",
        "https://h.example": "https://h.example/",
        "javascript:alert(1)": None,
        "file:///etc": None,
        "/relative": None,
        "https://": None,
        "https://h.example/?q=%7Etilde%2A": "https://h.example/?q=~tilde%2A",
        "https://h.example/?q=%zz": "https://h.example/?q=%25zz",
    }
    rows = values(spark, [(u,) for u in cases], "u string", "u", links.canonicalize_url(F.col("u")))
    assert dict(rows) == cases
    again = values(spark, [(c,) for c in cases.values() if c], "u string", "u", links.canonicalize_url(F.col("u")))
    assert all(a == b for a, b in again)


def test_links(spark):
    cases = [
        ("/jobs/1", "https://b.example/x/", "https://b.example/jobs/1", None),
        ("jobs/1?a=b", "https://b.example/x/", "https://b.example/x/jobs/1?a=b", None),
        ("../up", "https://b.example/x/y/", "https://b.example/x/up", None),
        ("https://o.example/1", "https://b.example/", "https://o.example/1", None),
        ("//o.example/1", "https://b.example/", None, "invalid description URL"),
        ("https:", "https://b.example/", None, "invalid description URL"),
        ("mailto:a@b", "https://b.example/", None, "invalid description URL"),
        ("https://o.example:x1/", "https://b.example/", None, "invalid description URL"),
        ("a b", "https://b.example/", None, "invalid description URL"),
        ("jobs", None, None, "invalid description URL"),
        ("", "https://b.example/", None, "description URL is required"),
        (None, "https://b.example/", None, "description URL is required"),
    ]
    link = links.resolve_url(F.col("raw"), F.col("base"), "description", required=True)
    got = values(spark, [c[:2] for c in cases], "raw string, base string", link["url"], link["error"])
    assert got == [c[2:] for c in cases]


def test_identity_hashes(spark):
    import hashlib

    a = links.fingerprint(F.lit("\tRye Baker "), F.lit("Großmühle"), F.lit("Pier 4"))
    b = links.fingerprint(F.lit("rye   BAKER"), F.lit("GROSSmühle"), F.lit("pier\u00a04"))
    h = links.content_hash(F.lit('a "b" \\ / é\n'), F.lit("u"), F.lit(None).cast("string"))
    x, y, z = spark.range(1).select(a, b, h).first()
    assert x == y == hashlib.sha256("rye baker\x1fgrossmühle\x1fpier 4".encode()).hexdigest()
    payload = json.dumps(['a "b" \\ / é\n', "u", ""], ensure_ascii=False, separators=(",", ":"))
    assert z == hashlib.sha256(payload.encode()).hexdigest()


@pytest.mark.parametrize(("place", "given", "region"), [
    ("Roma Norte, CDMX", None, "cdmx"), ("Tlaquepaque, Jalisco", None, "guadalajara"), ("Miami, USA", None, "usa"),
    ("Oslo", None, "other"), ("anywhere", "United States", "usa"), ("USA or Ciudad de México", None, "cdmx"),
    ("Mérida, México", None, "mexico"), (None, None, "other"),
])
def test_regions(spark, place, given, region):
    rows = values(spark, [(place, given)], "p string, g string", fields.classify_region(F.col("p"), F.col("g")))
    assert rows == [(region,)]


def test_fields(spark):
    day = datetime.date
    dates = {"1735689600000": day(2025, 1, 1), "2031-02-03T23:59:59Z": day(2031, 2, 3), "19700102": day(1970, 8, 17), "soon": None, "0": None, "2026-13-45": None, None: None}
    assert dict(values(spark, [(d,) for d in dates], "d string", "d", fields.parse_date(F.col("d")))) == dates
    numbers = {"$2,400.50": 2400.5, "-7.5": 7.5, "none": None, "": None, None: None}
    assert dict(values(spark, [(d,) for d in numbers], "d string", "d", fields.parse_number(F.col("d")))) == numbers
    money = {"$1 to $2 mxn": "MXN", "MX$ 3": "MXN", "$": "USD", "us$": "USD", "eur": "EUR", "euro": None, None: None}
    assert dict(values(spark, [(d,) for d in money], "d string", "d", fields.parse_currency(F.col("d")))) == money
    modes = {"remote / hybrid": "remote", "Hybrid": "hybrid", "On-site": "onsite", "true": "unknown", None: "unknown"}
    assert dict(values(spark, [(d,) for d in modes], "d string", "d", fields.classify_modality(F.col("d")))) == modes
    low, high = fields.salary_range(F.col("a"), F.col("b"), F.col("t"))
    rows = values(spark, [(None, None, "from $1,250 up to 2,400.5"), (1.0, None, "9"), (None, None, None)], "a double, b double, t string", low, high)
    assert rows == [(1250.0, 2400.5), (1.0, None), (None, None)]
    assert values(spark, [(1250.0, 24000.0)], "a double, b double", fields.salary_label(F.col("a"), F.col("b"), F.lit("EUR"))) == [("$1,250–$24,000 EUR/year",)]


def test_texts(spark):
    cases = {
        "<li>Fold <u>paper</u>!</li><noscript>off</noscript>": "Fold paper !",
        "a\rb\tc  d": "ab c d",
        "&amp; stays": "&amp; stays",
        None: None,
    }
    assert dict(values(spark, [(c,) for c in cases], "c string", "c", text.sanitize_text(F.col("c")))) == cases
    assert values(spark, [("Flour\n• Water;;Salt",)], "c string", text.split_requirements(F.col("c"))) == [(["Flour", "Water", "Salt"],)]
    assert values(spark, [("0", "[]", "x")], "a string, b string, c string", text.first_truthy(F.col("a"), F.col("b"), F.col("c"))) == [("x",)]
    secrets = F.create_map(*map(F.lit, ("api_key", "k", "note", "Bearer abc.def", "n", "1")))
    masked, dropped = spark.range(1).select(text.redact_map(secrets), text.drop_secret_keys(F.create_map(F.lit("Token"), F.lit("x"), F.lit("a"), F.lit("b")))).first()
    assert masked == {"api_key": "[REDACTED]", "note": "Bearer [REDACTED]", "n": "1"} and dropped == {"a": "b"}


def test_nested_redaction(spark):
    kind = "a struct<password:string, notes:array<string>, keys:struct<x:int>, api_key:array<int>>, b map<string,array<string>>, n int"
    rows = [(("p", ["Bearer x.y", None], (1,), [2]), {"Cookie": ["c"], "k": ["bearer z"]}, 5), (None, None, None)]
    got = text.redact_columns(spark.createDataFrame(rows, kind)).collect()
    assert got[0].a.asDict(True) == {"password": "[REDACTED]", "notes": ["Bearer [REDACTED]", None], "keys": {"x": 1}, "api_key": None}
    assert got[0].b == {"Cookie": None, "k": ["bearer [REDACTED]"]} and got[0].n == 5 and tuple(got[1]) == (None, None, None)


def test_experience(spark):
    kind = "e array<struct<years:double,years_experience:double,duration_years:double,text:string>>"
    rows = [([(2.0, None, None, None), (None, None, 1.5, None), (None, None, None, "9 years")],), ([(None, None, None, "unos 5+ años de pan")],), (None,), ([],)]
    assert values(spark, rows, kind, fields.experience_years(F.col("e"))) == [(3.5,), (5.0,), (0.0,), (0.0,)]


def test_sql_functions(spark):
    sql.register_sql_functions(spark)
    page = '<article class="job-card"><h2 class="title">Dev</h2><a href="/1">x</a></article>'
    spark.createDataFrame([(page,)], "html string").createOrReplaceTempView("some_pages")
    row = spark.sql("SELECT posting_text(html) t, posting_region('Zapopan') r, posting_fingerprint('A', 'b', NULL) f, c.fields['title'] title, c.url FROM some_pages, LATERAL scan_cards(html) c").first()
    expected = spark.range(1).select(links.fingerprint(F.lit("a"), F.lit("B"), F.lit(None).cast("string"))).first()[0]
    assert tuple(row) == ("Dev x", "guadalajara", expected, "Dev", "/1")
    urls = ["HTTP://u@H.example:80//a//?b=2&a=%7E*&ref=1#x", "https://h.example", "no", None, "https://h.example:8443/x/?q=a b"]
    spark.createDataFrame([(u,) for u in urls], "url string").createOrReplaceTempView("some_urls")
    both = spark.table("some_urls").select(F.expr("posting_url(url)"), links.canonicalize_url(F.col("url"))).collect()
    assert all(a == b for a, b in both) and both[0][0] == "http://h.example/a?a=~%2A&b=2"
