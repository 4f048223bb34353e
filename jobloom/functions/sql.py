"""Functions for SQL users, which Catalyst inlines: scalars and a table function for cards."""

from __future__ import annotations

from pyspark.sql import SparkSession

from jobloom.functions import fields
from jobloom.functions.links import HTTP, TRACKING_KEYS

_WHITE = r"(?U)[\\s\\p{Z}]+"


def register_sql_functions(spark: SparkSession) -> None:
    """``posting_text(html)``, ``posting_region(location)``, ``posting_fingerprint(title, company, location)``, ``posting_url(url)``, ``scan_cards(html)``."""
    from jobloom.sources.cards import cards_sql

    text = "html"
    for tag in ("script", "style", "noscript"):
        text = f"regexp_replace({text}, '(?is)<{tag}.*?>.*?</{tag}>', ' ')"
    text = f"regexp_replace(regexp_replace({text}, '<[^>]+>', ' '), '[\\\\x00-\\\\x08\\\\x0B-\\\\x1F]', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION posting_text(html STRING) RETURNS STRING RETURN btrim(regexp_replace({text}, '{_WHITE}', ' '))")
    folded = "translate(lower(coalesce(location, '')), 'áàäéèëíìïóòöúùü', 'aaaeeeiiiooouuu')"
    tests = " ".join(
        f"WHEN {folded} RLIKE '{pattern.replace(chr(92), chr(92) * 2)}' THEN '{region}'"
        for region, pattern in (("cdmx", fields.CDMX), ("guadalajara", fields.GUADALAJARA), ("usa", fields.USA), ("mexico", fields.MEXICO))
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION posting_region(location STRING) RETURNS STRING RETURN CASE {tests} ELSE 'other' END")
    part = "replace(lower(btrim(regexp_replace(coalesce(COLUMN, ''), '" + _WHITE + "', ' '))), 'ß', 'ss')"
    joined = ", chr(31), ".join(part.replace("COLUMN", c) for c in ("title", "company", "location"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION posting_fingerprint(title STRING, company STRING, location STRING) "
        f"RETURNS STRING RETURN sha2(concat({joined}), 256)"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION posting_url(url STRING) RETURNS STRING RETURN {_canonical_url('btrim(url)')}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION scan_cards(html STRING) RETURNS TABLE "
        "(card_idx INT, fields MAP<STRING, STRING>, url STRING, application_url STRING) RETURN "
        "SELECT pos, col.fields, coalesce(col.link, col.fields['url']), coalesce(col.apply, col.fields['application_url']) "
        f"FROM posexplode({cards_sql('scan_cards.html')})"
    )


def _canonical_url(url: str) -> str:
    """SQL of ``links.canonicalize_url``."""
    def part(n: int) -> str:
        return f"regexp_extract({url}, r'{HTTP}', {n})"

    def encoded(x: str) -> str:
        return f"replace(replace(url_encode({x}), '*', '%2A'), '%7E', '~')"

    def decoded(pattern: str) -> str:
        return f"coalesce(try_url_decode(regexp_extract(p, '{pattern}', 1)), regexp_extract(p, '{pattern}', 1))"

    scheme, netloc = f"lower({part(1)})", f"regexp_replace({part(2)}, '^.*@', '')"
    host, port = f"lower(regexp_replace({netloc}, r':\\d*$', ''))", f"regexp_extract({netloc}, r':0*(\\d+)$', 1)"
    place = f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN {host} ELSE concat({host}, ':', {port}) END"
    path = f"regexp_replace({part(3)}, '/{{2,}}', '/')"
    path = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/+$', '') END"
    pairs = f"transform(filter(split({part(4)}, '&'), p -> p <> ''), p -> struct({decoded('^([^=]*)')} AS k, {decoded('=(.*)$')} AS v))"
    tracking = ", ".join(f"'{key}'" for key in TRACKING_KEYS)
    kept = f"array_sort(filter({pairs}, p -> lower(p.k) NOT IN ({tracking}) AND NOT startswith(lower(p.k), 'utm_')))"
    query = f"array_join(transform({kept}, p -> concat({encoded('p.k')}, '=', {encoded('p.v')})), '&')"
    whole = f"concat({scheme}, '://', {place}, {path}, CASE WHEN {query} <> '' THEN concat('?', {query}) ELSE '' END)"
    return f"CASE WHEN {url} RLIKE r'{HTTP}' AND {part(2)} <> '' THEN {whole} END"
