"""Career-page cards in HTML, by selectors over SQL expressions.

A page is split where a card opens; a card is split where a start tag stands, and each part (a tag with the
text after it) is matched with the field selectors. Fields and links are projections of these parts, so a
page is read in one narrow stage without a shuffle or Python. The expressions are SQL text, which the
DataFrame operators and the SQL functions share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What marks a field in a class (later ones win), and a link of application.
MARKERS = {"title": "title", "position": "title", "description": "description", "location": "location"}
APPLY_WORDS = ("apply", "postular", "application")
# Named character references that are decoded; the ampersand comes last.
REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•",
    "euro": "€", "copy": "©", "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "ntilde": "ñ",
    "uuml": "ü", "ouml": "ö", "auml": "ä", "amp": "&",
}

# In patterns, \x22 and \x27 are the quotes, so that SQL strings can hold them.
_IN_TAG = r"(?:[^>\x22\x27]|\x22[^\x22]*\x22|\x27[^\x27]*\x27)*+"
_SILENT = r"(?is)<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)"
_CLASS = r"\sclass\s*=\s*(?:\x22[^\x22>]*job-card|\x27[^\x27>]*job-card|[^\s\x22\x27>]*job-card)"
_JOB = r"\sdata-job\s*=\s*[\x22\x27]?true\b"
_OPENER = rf"(?is)(?=<(?:article(?=[\s/>])|[a-z](?=[^>]*?{_JOB})|[a-z](?=[^>]*?{_CLASS})){_IN_TAG}>)"
_CLOSER = r"(?is)</(?:article|li)\s*>.*$"
_LINK = rf"(?is)<a\b({_IN_TAG})>((?:(?!<a\b).)*?)</a\s*>"


def _let(name: str, value: str, body: str) -> str:
    """``body`` in which ``name`` is ``value``, which is computed once; within lambdas Spark shares nothing by itself."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _attribute(tag: str, name: str) -> str:
    """The value of an attribute in the text of a start tag; empty if it is missing."""
    pattern = rf"(?is)[\s\x22\x27]{name}\s*=\s*(\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s\x22\x27>]+)"
    unquoted = "CASE WHEN left(v, 1) IN (chr(34), chr(39)) THEN substring(v, 2, length(v) - 2) ELSE v END"
    return _let("v", f"regexp_extract({tag}, r'{pattern}', 1)", unquoted)


def _field(tag: str) -> str:
    """The field that an element fills: by the last marker in its class, else by ``data-field``."""
    marked = " ".join(f"WHEN contains(kinds, '{marker}') THEN '{field}'" for marker, field in reversed(MARKERS.items()))
    # ``nullif`` would compute its first part twice.
    named = _let("named", _attribute(tag, "data-field"), "CASE WHEN named <> '' THEN named END")
    return _let("kinds", f"lower({_attribute(tag, 'class')})", f"CASE {marked} ELSE {named} END")


def _plain(text: str) -> str:
    """Text without tags and surplus white space."""
    return rf"btrim(regexp_replace(regexp_replace({text}, r'(?s)<[^>]*>', ' '), r'\s+', ' '))"


def _decoded(text: str) -> str:
    """Numeric and some named character references replaced; others stay."""
    codes = r"array_distinct(filter(regexp_extract_all(d, r'&#(\d{1,6});', 1), n -> int(n) BETWEEN 9 AND 55295))"
    whole = f"aggregate({codes}, d, (t, n) -> replace(t, concat('&#', n, ';'), decode(unhex(lpad(hex(int(n)), 8, '0')), 'UTF-32')))"
    for name, sign in REFERENCES.items():
        quoted = sign.replace("'", "''")
        whole = f"replace({whole}, '&{name};', '{quoted}')"
    return _let("d", text, f"CASE WHEN contains(d, '&') THEN {whole} ELSE d END")


def cards_sql(page: str) -> str:
    """SQL of the cards of a page: an array of ``(fields, link, apply)``.

    A card opens at ``<article>``, ``data-job="true"`` or a ``job-card`` class and ends at the next ``</article>``
    or ``</li>``; one that opens within an unfinished card replaces it, and an unfinished one is none.
    """
    parts = f"split(regexp_replace(coalesce({page}, ''), r'{_SILENT}', ' '), r'{_OPENER}')"
    whole = f"filter({parts}, part -> part RLIKE r'{_OPENER}' AND part RLIKE r'{_CLOSER}')"
    cards = f"transform({whole}, part -> regexp_replace(part, r'{_CLOSER}', ''))"
    pieces = "filter(split(card, r'(?s)(?=<[a-zA-Z])'), p -> p RLIKE '^<[a-zA-Z]')"
    tag = f"regexp_extract(p, r'(?s)^<{_IN_TAG}>', 0)"
    # The text of a link describes the link; that of any other element its field.
    linked = f"p RLIKE r'(?i)^<a\\b' AND {_attribute('p', 'href')} <> ''"
    filled = f"CASE WHEN NOT ({linked}) THEN {_let('tag', tag, _field('tag'))} END"
    told = f"struct(f AS field, CASE WHEN f IS NOT NULL THEN {_decoded(_plain('p'))} END AS text)"
    read = f"filter(transform({pieces}, p -> {_let('f', filled, told)}), p -> p.field IS NOT NULL AND p.text <> '')"
    # Texts of one field are joined in their order.
    fields = "aggregate(read, map_from_arrays(array(''), array('')), (m, p) -> map_concat(map_filter(m, (k, v) -> k <> p.field), " \
        "map(p.field, concat_ws(' ', m[p.field], p.text))))"
    start, inner = rf"regexp_extract(x, r'(?is)^<a\b({_IN_TAG})>', 1)", rf"regexp_replace(x, r'(?is)^<a\b{_IN_TAG}>|</a\s*>$', '')"
    about = f"lower(concat_ws(' ', {_attribute('tag', 'class')}, {_field('tag')}, {_plain(inner)}))"
    applies = f"{about} RLIKE '{'|'.join(APPLY_WORDS)}'"
    links = f"transform(regexp_extract_all(card, r'{_LINK}', 0), x -> {_let('tag', start, f'struct({_attribute("tag", "href")} AS href, {applies} AS applies)')})"
    links = f"filter({links}, x -> x.href <> '')"
    given = _let("read", read, f"map_filter({fields}, (k, v) -> k <> '')")
    made = f"struct({given} AS fields, get(filter(links, x -> NOT x.applies), 0).href AS link, try_element_at(filter(links, x -> x.applies), -1).href AS apply)"
    return f"transform({cards}, card -> {_let('links', links, made)})"


def scan_cards(pages: DataFrame) -> DataFrame:
    """``pages(html, ...)`` → one row per card with the other columns of ``pages``: ``card_idx, fields, url, application_url``.

    ``fields`` maps every field that the card fills (``title``, ``company``, ``salary``, ...) to its text. ``url`` is the
    first link that is not one of application, ``application_url`` the last one that is. A null page has no cards.
    """
    others = [c for c in pages.columns if c.lower() not in ("html", "card_idx", "fields", "url", "application_url")]
    cards = pages.select(*others, F.posexplode(F.expr(cards_sql("html"))).alias("card_idx", "_card"))
    return cards.select(
        *others, "card_idx", F.col("_card.fields").alias("fields"),
        F.coalesce("_card.link", F.col("_card.fields")["url"]).alias("url"),
        F.coalesce("_card.apply", F.col("_card.fields")["application_url"]).alias("application_url"),
    )


def card_items(pages: DataFrame) -> DataFrame:
    """Cards of ``pages(source, html, ...)`` as feed items ``item_idx, item``: what ``normalize_items`` reads.

    A card without a link to its description has none, which the normalization reports.
    """
    cards = scan_cards(pages)
    others = [c for c in cards.columns if c not in ("card_idx", "fields", "url", "application_url")]
    links = F.create_map(F.lit("description_url"), F.col("url"), F.lit("application_url"), F.col("application_url"))
    own = F.map_filter("fields", lambda k, _: ~k.isin("url", "description_url", "application_url"))
    item = F.map_concat(own, F.map_filter(links, lambda _, x: x.isNotNull()))
    return cards.select(*others, F.col("card_idx").alias("item_idx"), F.try_parse_json(F.to_json(item)).alias("item"))


def scan_articles(pages: DataFrame) -> DataFrame:
    """Flat ``<article><h1>`` pages with built-in functions: ``page_id, card_idx, title, body``."""
    from jobloom.functions.text import sanitize_text

    cards = F.regexp_extract_all("html", F.lit(r"(?s)<article[^>]*>(.*?)</article>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(cards).alias("card_idx", "card"))
    title = sanitize_text(F.regexp_extract("card", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    body = sanitize_text(F.regexp_replace("card", r"(?s)<h1[^>]*>.*?</h1>", " "))
    return rows.select("page_id", "card_idx", title.alias("title"), body.alias("body"))
