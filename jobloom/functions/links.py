"""Links and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import squash

# Query keys that only track visits (besides all that begin with utm_).
TRACKING_KEYS = ("fbclid", "gclid", "dclid", "mc_cid", "mc_eid", "ref", "referrer", "source")
HTTP = r"^(?i)(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, HTTP, n)


def normalize_base_url(c: Column) -> Column:
    """``scheme://netloc/path/`` of an absolute HTTP(S) URL; else null."""
    url = F.btrim(c)
    path = _part(url, 3)
    path = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    base = F.concat(F.lower(_part(url, 1)), F.lit("://"), _part(url, 2), path)
    return F.when(url.rlike(HTTP) & (_part(url, 2) != ""), base)


def _encode(c: Column) -> Column:
    """Form encoding: ``*`` is escaped, ``~`` is not."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(c: Column) -> Column:
    """A stable URL without user, default port, fragment and tracking keys, with sorted query; else null."""
    url = F.btrim(c)
    scheme, netloc = F.lower(_part(url, 1)), F.regexp_replace(_part(url, 2), "^.*@", "")
    host = F.lower(F.regexp_replace(netloc, r":\d*$", ""))
    port = F.regexp_extract(netloc, r":0*(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    place = F.when(default, host).otherwise(F.concat(host, F.lit(":"), port))
    path = F.regexp_replace(_part(url, 3), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.transform(
        F.filter(F.split(_part(url, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.coalesce(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)), F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            F.coalesce(F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)), F.regexp_extract(p, "=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS) & ~F.lower(p["k"]).startswith("utm_"))
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )
    whole = F.concat(scheme, F.lit("://"), place, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(HTTP) & (_part(url, 2) != ""), whole)


def _fold_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    ends = path.rlike(r"/\.{1,2}$")
    joined = F.array_join(folded, "/")
    return F.when(ends, F.concat(F.regexp_replace(joined, "/$", ""), F.lit("/"))).otherwise(joined)


def resolve_url(raw: Column, base: Column, field: str, required: bool = False) -> Column:
    """``struct<url, error>``: a link against a normalized base; errors name the field."""
    text = F.btrim(raw)
    absent = raw.isNull() | (text == "")
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    path, tail = F.regexp_extract(text, "^([^?#]*)", 1), F.regexp_extract(text, "^[^?#]*(.*)$", 1)
    has_scheme = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    bad = (
        text.startswith("//")
        | (has_scheme & ~text.rlike(r"^(?i)https?://[^/?#\s]+"))
        | text.rlike(r"[\x00-\x20\x7F]")
        | (has_scheme & F.regexp_extract(text, r"^[^/]*//[^/?#]*:([^/?#:@]*)(?:[/?#]|$)", 1).rlike(r"\D"))
        | (~has_scheme & (base.isNull() | (base == "")))
    )
    joined = (
        F.when(has_scheme, text)
        .when(text.startswith("/"), F.concat(origin, _fold_dots(path), tail))
        .when(text.startswith("?") | text.startswith("#"), F.concat(base, text))
        .otherwise(F.concat(origin, _fold_dots(F.concat(_part(base, 3), path)), tail))
    )
    error = F.when(absent & F.lit(required), f"{field} URL is required").when(~absent & bad, f"invalid {field} URL")
    return F.struct(F.when(~absent & ~bad, joined).alias("url"), error.alias("error"))


def fingerprint(title: Column, company: Column, location: Column) -> Column:
    """SHA-256 of title, company and location, case and white space folded."""
    def part(c: Column) -> Column:
        return F.replace(F.lower(squash(F.coalesce(c, F.lit("")))), F.lit("ß"), F.lit("ss"))

    unit = F.lit("\x1f")
    return F.sha2(F.concat(part(title), unit, part(company), unit, part(location)), 256)


def content_hash(description: Column, description_url: Column, application_url: Column) -> Column:
    """SHA-256 of the compact JSON list of the three."""
    empty = F.lit("")
    items = F.array(F.coalesce(description, empty), F.coalesce(description_url, empty), F.coalesce(application_url, empty))
    return F.sha2(F.to_json(items), 256)
