"""Text columns: sanitizing, lists, resume lines, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space including the no-break space and its kin.
WHITE = r"[\s\p{Z}]+"


def squash(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, WHITE, " "))


def sanitize_text(c: Column) -> Column:
    """Drop script, style and noscript blocks, then tags, then control characters; entities stay as they are."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}.*?>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return squash(F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", ""))


def falsy(c: Column) -> Column:
    """Whether a JSON text value counts as absent: null, "", 0, false, [] or {}."""
    return c.isNull() | F.btrim(c).isin("", "0", "0.0", "false", "[]", "{}", "null")


def first_truthy(*columns: Column) -> Column:
    """The first value that does not count as absent."""
    return F.get(F.filter(F.array(*columns), lambda c: ~falsy(c)), F.lit(0))


def split_requirements(c: Column) -> Column:
    """Pieces between line ends, bullets and semicolons, sanitized, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n|[•;]"), sanitize_text), lambda x: x != "")


def clean_resume_text(c: Column) -> Column:
    """NULs out, blanks and tabs collapsed per line, at most one empty line; null under 20 characters."""
    lines = F.transform(
        F.split(F.regexp_replace(c, "\x00", ""), "\r\n|\n|\r"),
        lambda line: F.btrim(F.regexp_replace(line, "[ \t]+", " ")),
    )
    text = F.regexp_replace(F.array_join(lines, "\n"), "^\n+|\n+$", "")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.when(F.length(text) >= 20, text)


# Names of fields and settings that hold secrets.
SECRET_KEY = r"(?i)(token|secret|password|passwd|api[-_]?key|authorization|cookie|credential)"
SECRET_CONFIG_KEY = r"(?i)(token|secret|password|cookie)"


def redact_text(c: Column) -> Column:
    """Mask bearer values."""
    return F.regexp_replace(c, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]")


def redact_map(c: Column) -> Column:
    """Mask values of secret keys, and bearer values in others."""
    return F.transform_values(c, lambda k, v: F.when(k.rlike(SECRET_KEY), "[REDACTED]").otherwise(redact_text(v)))


def redact(c: Column, kind: T.DataType) -> Column:
    """Mask secrets at any depth of maps, structs and arrays; other types stay as they are."""
    secret = re.compile(SECRET_KEY)

    def of_field(f: T.StructField) -> Column:
        if secret.search(f.name) and isinstance(f.dataType, T.StringType):
            return F.lit("[REDACTED]").alias(f.name)
        hidden = F.lit(None).cast(f.dataType) if secret.search(f.name) else redact(c[f.name], f.dataType)
        return hidden.alias(f.name)

    def of_value(k: Column, x: Column) -> Column:
        named = k.cast("string").rlike(SECRET_KEY)
        masked = F.lit("[REDACTED]") if isinstance(kind.valueType, T.StringType) else F.lit(None).cast(kind.valueType)
        return F.when(named, masked).otherwise(redact(x, kind.valueType))

    if isinstance(kind, T.StringType):
        return redact_text(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, of_value)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*map(of_field, kind.fields)))
    return c


def redact_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with secrets masked in the named columns (all if none is named)."""
    return df.withColumns({n: redact(F.col(n), df.schema[n].dataType) for n in names or df.columns})


def drop_secret_keys(c: Column) -> Column:
    return F.map_filter(c, lambda k, _: ~k.rlike(SECRET_CONFIG_KEY))
