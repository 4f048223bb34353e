"""Feeds and card pages: items, normalization into postings, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.fields import classify_modality, classify_region, parse_currency, parse_date, parse_number, salary_range
from jobloom.functions.links import normalize_base_url, resolve_url
from jobloom.functions.text import falsy, first_truthy, sanitize_text, split_requirements
from jobloom.sources.cards import card_items
from jobloom.sources.scratch import materialize

# The keys under which providers send a field, in the order in which they are tried.
ALIASES = {
    "title": ("title", "name", "jobTitle", "text"),
    "company": ("company", "employer", "company_name", "companyName"),
    "description": ("description", "descriptionHtml", "content", "descriptionPlain", "summary", "jobDescription"),
    "description_url": ("description_url", "url", "absolute_url", "hostedUrl", "jobUrl"),
    "application_url": ("application_url", "apply_url", "applyUrl"),
    "canonical_url": ("canonical_url", "absolute_url", "hostedUrl"),
    "location": ("location", "locations", "candidate_required_location", "jobLocation", "jobGeo"),
    "salary_min": ("salary_min", "salaryMin"),
    "salary_max": ("salary_max", "salaryMax"),
    "currency": ("salary_currency", "currency", "salaryCurrency", "salary"),
    "requirements": ("requirements", "qualifications", "must_have"),
    "published": ("published_at", "date_posted", "publication_date", "created_at", "first_published", "createdAt", "publishedAt", "pubDate"),
    "period": ("salary_period", "pay_period", "salaryPeriod"),
    "modality": ("modality", "workplace_type", "workplaceType", "remote"),
}
# Keys of which a posting has at least one.
JOB_KEYS = (
    "title", "name", "text", "description", "content", "descriptionPlain", "url", "absolute_url", "hostedUrl", "jobUrl",
    "applyUrl", "company", "company_name", "descriptionHtml", "companyName", "location", "categories",
)


def field(item: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{key}", kind)


def scan_json_feed(raw: DataFrame) -> DataFrame:
    """``raw(source, payload, ...)`` → one row per item, ``item`` a variant, with the other columns of ``raw``.

    The payload is a list, or an object with ``jobs``, else ``data``; anything else has no items.
    """
    v = F.try_parse_json("payload")
    kind = F.schema_of_variant(v)
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(
        F.when(F.try_variant_get(v, "$.jobs", "variant").isNotNull(), F.try_variant_get(v, "$.jobs", "array<variant>"))
        .otherwise(F.try_variant_get(v, "$.data", "array<variant>"))
    )
    others = [c for c in raw.columns if c != "payload"]
    return raw.select(*others, F.posexplode(items).alias("item_idx", "item"))


def is_object(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def drop_legal_envelope(items: DataFrame) -> DataFrame:
    """Without items that hold ``legal`` and no key of a posting."""
    def has(key: str) -> Column:
        return F.try_variant_get("item", f"$.{key}", "variant").isNotNull()

    legal = has("legal")
    for key in JOB_KEYS:
        legal &= ~has(key)
    return items.filter(~F.coalesce(legal & is_object(F.col("item")), F.lit(False)))


def stated(value: Column) -> Column:
    """A variant as text, null if it counts as absent: a number 0, false, an empty list or object, but of JSON texts only an empty one."""
    text = F.try_variant_get(value, "$", "string")
    # The kind is only looked at where the text alone does not tell.
    return F.when(~falsy(text) | ((F.btrim(text) != "") & (F.schema_of_variant(value) == "STRING")), text)


def _pick(item: Column, name: str) -> Column:
    return F.coalesce(*[stated(F.try_variant_get(item, f"$.{key}", "variant")) for key in ALIASES[name]])


def _pick_by(keys: Column, members: Column) -> Column:
    """The first value under one of ``keys`` that does not count as absent, among the members of an object."""
    tried = F.transform(keys, lambda key: stated(F.try_element_at(members, key)))
    return F.get(F.array_compact(tried), F.lit(0))


def pick_location(item: Column) -> Column:
    """The place of an item: an object gives its name or location, a list its values joined."""
    def one(key: str) -> Column:
        inner = first_truthy(field(item, f"{key}.name"), field(item, f"{key}.location"))
        listed = F.array_join(field(item, key, "array<string>"), ", ")
        kind = F.schema_of_variant(F.try_variant_get(item, f"$.{key}", "variant"))
        return F.when(kind.startswith("OBJECT"), inner).when(kind.startswith("ARRAY"), listed).otherwise(field(item, key))

    found = first_truthy(*[one(key) for key in ALIASES["location"]], field(item, "categories.location"))
    return F.nullif(F.btrim(found), F.lit(""))


def merge_metadata(item: Column, source: Column, requirements: Column) -> Column:
    """Adapter and requirements, overridden by the provider's map; what is no map is kept under ``provider_metadata``."""
    given = F.try_variant_get(item, "$.metadata", "variant")
    kind = F.coalesce(F.schema_of_variant(given), F.lit("VOID"))
    provider = F.try_variant_get(given, "$", "map<string,string>")
    other = F.create_map(F.lit("provider_metadata"), F.to_json(given))
    empty = F.create_map().cast("map<string,string>")
    added = F.when(kind.startswith("OBJECT"), F.coalesce(provider, empty)).when(kind == "VOID", empty).otherwise(other)
    own = F.create_map(F.lit("source_adapter"), source.cast("string"), F.lit("requirements"), F.to_json(requirements))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(added, k))
    return F.map_concat(kept, added)


#: The order of items of several sources.
SOURCE_ORDER = ("source", "item_idx")


def union_sources(*items: DataFrame) -> DataFrame:
    """Items of several sources; order is source name, then position."""
    out = items[0]
    for more in items[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def normalize_items(items: DataFrame) -> DataFrame:
    """Postings from ``items(source, item_idx, item, base_url, default_company)``, with ``errors``.

    Items may bring ``aliases``, a map of fields to the keys under which they are sent, tried in their order; fields
    that it does not name are looked for under the usual keys.
    """
    item = F.col("item")
    # Picked once, so that later steps refer to columns and not to the lookups.
    picked = {f"_p_{name}": _pick(item, name) for name in ALIASES if name not in ("location", "modality")}
    place, mode_key = pick_location(item), None
    if own := "aliases" in items.columns:
        items = items.withColumn("_members", F.when(F.col("aliases").isNotNull(), F.try_variant_get(item, "$", "map<string,variant>")))
        keys = {name: F.try_element_at("aliases", F.lit(name)) for name in ALIASES}
        picked = {f"_p_{name}": F.when(keys[name].isNotNull(), _pick_by(keys[name], F.col("_members"))).otherwise(_pick(item, name)) for name in ALIASES if name not in ("location", "modality")}
        place = F.when(keys["location"].isNotNull(), F.nullif(F.btrim(_pick_by(keys["location"], F.col("_members"))), F.lit(""))).otherwise(place)
        mode_key = F.when(keys["modality"].isNotNull(), _pick_by(keys["modality"], F.col("_members")))
    df = items.withColumns({"_base": normalize_base_url(F.col("base_url")), "location": place, **picked})
    requirements = field(item, "requirements", "array<string>")
    split = split_requirements(F.col("_p_requirements"))
    cleaned = F.filter(F.transform(requirements, sanitize_text), lambda x: x != "")
    df = df.withColumns({
        "_min": parse_number(F.col("_p_salary_min")),
        "_max": parse_number(F.col("_p_salary_max")),
        "_description": resolve_url(F.col("_p_description_url"), F.col("_base"), "description", required=True),
        "_application": resolve_url(F.col("_p_application_url"), F.col("_base"), "application"),
        "_canonical": resolve_url(F.col("_p_canonical_url"), F.col("_base"), "canonical"),
    })
    low, high = salary_range(F.col("_min"), F.col("_max"), field(item, "salary"))
    flagged = F.when(field(item, "isRemote", "boolean"), F.lit("remote"))
    mode = first_truthy(*([mode_key] if own else []), *[field(item, k) for k in ALIASES["modality"]], flagged, field(item, "jobType"), F.col("location"))
    df = df.withColumns({
        "title": F.btrim(F.coalesce(F.col("_p_title"), F.lit("Untitled role"))),
        "company": F.btrim(F.coalesce(F.col("_p_company"), F.col("default_company"), F.lit(""))),
        "description": sanitize_text(F.coalesce(F.col("_p_description"), F.lit("No description provided"))),
        "description_url": F.col("_description.url"),
        "application_url": F.col("_application.url"),
        "canonical_url": F.coalesce("_canonical.url", "_description.url"),
        "region": classify_region(F.col("location"), field(item, "region")),
        "modality": classify_modality(mode),
        "salary_min": low,
        "salary_max": high,
        "salary_currency": parse_currency(F.col("_p_currency")),
        "salary_period": F.nullif(F.lower(F.btrim(F.col("_p_period"))), F.lit("")),
        "published_at": parse_date(F.col("_p_published")),
        "requirements": F.coalesce(cleaned, split, F.array().cast("array<string>")),
    })
    df = df.withColumn("metadata", merge_metadata(item, F.col("source"), F.col("requirements")))
    links = F.array("_description.error", "_application.error", "_canonical.error")
    not_object = F.when(~is_object(item), "item must be an object with a description URL")
    df = df.withColumn("_found", F.when(not_object.isNotNull(), F.array(not_object)).otherwise(F.array_compact(links)))
    return df.drop("_base", "_min", "_max", "_description", "_application", "_canonical", "item", "base_url", "default_company", "aliases", "_members", *picked)


def violations(df: DataFrame) -> Column:
    """Messages of broken rules of a posting."""
    checks = [
        F.when(F.coalesce(F.btrim("title"), F.lit("")) == "", "title is required"),
        F.when(F.coalesce(F.btrim("company"), F.lit("")) == "", "company is required"),
        F.when(F.coalesce(F.btrim("description"), F.lit("")) == "", "description is required"),
        F.when(F.col("salary_min") > F.col("salary_max"), "salary_min cannot exceed salary_max"),
        F.when(~F.col("salary_currency").rlike("^[A-Z]{3}$"), "salary_currency must be a 3-letter code"),
        F.when(~F.col("description_url").rlike(r"^https?://[^/]+"), "description_url must be an http(s) URL"),
    ]
    return F.array_compact(F.array(*checks))


def check_postings(df: DataFrame) -> DataFrame:
    """Add ``error``: null for a posting that breaks no rule, else all its messages."""
    errors = violations(df)
    if "_found" in df.columns:
        errors = F.concat("_found", errors)
    joined = F.concat(F.lit("invalid job: "), F.array_join("_errors", "; "))
    return df.withColumn("_errors", errors).withColumn("error", F.when(F.size("_errors") > 0, joined)).drop("_found", "_errors")


def validate_postings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): a row with broken rules is set aside with its messages and drops no other.

    Checked rows are written once, so that neither side normalizes them again.
    """
    checked = materialize(check_postings(df), "checked")
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def scan_items(raw: DataFrame) -> DataFrame:
    """Items of ``raw(source, payload, html, ...)``: of the JSON payload, else of the cards of the page; either column may be missing."""
    parts = []
    if "payload" in raw.columns:
        parts.append(scan_json_feed(raw.filter("payload is not null").drop("html")))
    if "html" in raw.columns:
        pages = raw.filter("payload is null").drop("payload") if "payload" in raw.columns else raw
        parts.append(card_items(pages))
    if not parts:
        raise ValueError("neither payload nor html")
    return union_sources(*parts)


def paged(raw: DataFrame) -> DataFrame:
    """``raw`` with ``page`` as a text that orders the payloads of a source and tells them apart.

    A source may send many payloads, and items are counted within each. ``page`` (a number, if ``raw`` has it) comes
    first, then a hash of the payload; equal payloads of a page have equal items, so their places need not differ.
    """
    number = F.coalesce(F.col("page").cast("string"), F.lit("0")) if "page" in raw.columns else F.lit("0")
    sent = F.xxhash64(*[c for c in ("base_url", "default_company", "adapter", "payload", "html") if c in raw.columns])
    return raw.withColumn("page", F.concat(F.lpad(number, 12, "0"), F.lit("."), F.lpad(F.hex(sent), 16, "0")))


def read_feeds(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan, normalize and validate ``raw(source, base_url, default_company, payload)``, or ``html`` for card pages."""
    return validate_postings(normalize_items(drop_legal_envelope(scan_items(raw))))


def validate_payloads(raw: DataFrame) -> DataFrame:
    """Add ``error`` to ``raw(payload)``: not JSON, not an object, no jobs, or the first item without a link (from 1)."""
    v = F.try_parse_json("payload")
    jobs = F.coalesce(F.try_variant_get(v, "$.jobs", "array<variant>"), F.try_variant_get(v, "$.data", "array<variant>"))
    linked = F.transform(jobs, lambda i: first_truthy(field(i, "description_url"), field(i, "url")).isNotNull())
    missing = F.array_position(linked, F.lit(False))
    error = (
        F.when(v.isNull(), "payload is not valid JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "payload must be an object")
        .when(F.coalesce(F.size(jobs), F.lit(0)) <= 0, "jobs must be a non-empty list")
        .when(missing > 0, F.concat(F.lit("job "), missing.cast("string"), F.lit(" needs description_url or url")))
    )
    return raw.withColumn("error", error)
