"""Posting fields: dates, numbers, salaries, regions, modalities, experience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places that decide the region, tried in this order.
CDMX = r"\b(cdmx|ciudad de mexico|mexico city|distrito federal)\b"
GUADALAJARA = r"\b(guadalajara|guadajalara|zapopan|jalisco)\b"
USA = r"\b(usa|u\.s\.a\.?|united states|estados unidos|\b(us)\b)"
MEXICO = (
    r"\b(mexico|mejico|republica mexicana|estado de mexico|edomex|mx|monterrey|queretaro|puebla|merida|tijuana)\b"
)
REGIONS = ("cdmx", "guadalajara", "mexico", "usa", "other")


def parse_date(c: Column) -> Column:
    """Epoch seconds (milliseconds from 1e11 on) or an ISO date in the first ten characters; else null."""
    text = F.btrim(c)
    value = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
    seconds = F.when(F.abs(value) >= 1e11, value / 1000).otherwise(value)
    sane = F.when(F.abs(seconds) < 2.5e11, seconds)
    epoch = F.to_date(F.timestamp_seconds(sane))
    iso = F.when(F.left(text, F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.left(text, F.lit(10)).try_cast("date"))
    return F.when(value == 0, None).when(value.isNotNull(), epoch).otherwise(iso)


def parse_number(c: Column) -> Column:
    """The first number of a text, thousands separators removed; a sign is not read."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"\d+(?:\.\d+)?", 0).try_cast("double")


def salary_range(low: Column, high: Column, text: Column) -> tuple[Column, Column]:
    """Structured bounds; only if both are absent, the first and last amount of the text."""
    amounts = F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    scan = low.isNull() & high.isNull()
    first = parse_number(F.try_element_at(amounts, F.lit(1)))
    last = parse_number(F.try_element_at(amounts, F.lit(-1)))
    return F.when(scan, first).otherwise(low), F.when(scan, last).otherwise(high)


def parse_currency(c: Column) -> Column:
    text = F.upper(F.btrim(c))
    return (
        F.when(text.contains("MXN") | text.contains("MX$"), "MXN")
        .when(text.contains("USD") | text.contains("US$") | (text == "$"), "USD")
        .when(text.rlike("^[A-Z]{3}$"), text)
    )


def fold_vowels(c: Column) -> Column:
    """Lower case, vowels without acute, grave and diaeresis; ñ stays."""
    return F.translate(F.lower(c), "áàäéèëíìïóòöúùü", "aaaeeeiiiooouuu")


def classify_region(location: Column, explicit: Column | None = None) -> Column:
    given = F.lit("") if explicit is None else F.coalesce(explicit, F.lit(""))
    text = fold_vowels(F.concat(given, F.lit(" "), F.coalesce(location, F.lit(""))))
    return (
        F.when(text.rlike(CDMX), "cdmx").when(text.rlike(GUADALAJARA), "guadalajara")
        .when(text.rlike(USA), "usa").when(text.rlike(MEXICO), "mexico").otherwise("other")
    )


def classify_modality(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    office = text.contains("onsite") | text.contains("on-site") | text.contains("office")
    return (
        F.when(text.contains("remote"), "remote").when(text.contains("hybrid"), "hybrid")
        .when(office, "onsite").otherwise("unknown")
    )


def salary_label(low: Column, high: Column, currency: Column) -> Column:
    money = F.concat(F.lit("$"), F.format_number(low, 0), F.lit("–$"), F.format_number(high, 0))
    label = F.concat(money, F.lit(" "), F.coalesce(currency, F.lit("")), F.lit("/year"))
    return F.when(low.isNotNull() & high.isNotNull(), label).otherwise("Not specified")


# Fixed value: how a text states years of experience.
YEARS = r"(\d+(?:\.\d+)?)\s*(?:\+\s*)?(?:years?|años?|anos?)"


def years_in_text(c: Column) -> Column:
    """The years of ``N years`` (or años, anos) in a text."""
    return F.regexp_extract(F.lower(c), YEARS, 1).try_cast("double")


def experience_years(entries: Column) -> Column:
    """Sum over entries: years, years_experience or duration_years, else years named in the text.

    Once one structured entry counted, text of later entries no longer does.
    """
    def step(s: Column, e: Column) -> Column:
        stated = F.coalesce(e["years"], e["years_experience"], e["duration_years"])
        read = F.when(~s["found"], years_in_text(F.coalesce(e["text"], F.lit(""))))
        return F.struct(
            (s["total"] + F.coalesce(stated, read, F.lit(0.0))).alias("total"),
            (s["found"] | stated.isNotNull() | read.isNotNull()).alias("found"),
        )

    start = F.struct(F.lit(0.0).alias("total"), F.lit(False).alias("found"))
    return F.coalesce(F.aggregate(entries, start, step)["total"], F.lit(0.0))
