"""Profiles from resume text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.text import clean_resume_text

# Section headings and known skills.
SECTIONS = {
    "skills": ("skills", "technical skills", "habilidades"),
    "experience": ("experience", "professional experience", "work experience", "experiencia"),
    "education": ("education", "formación", "formacion", "educacion"),
    "languages": ("languages", "idiomas"),
}
# Skills that are known by name, and the largest file.
KNOWN_SKILLS = (
    "python", "javascript", "typescript", "java", "c#", ".net", "go", "rust", "sql", "postgresql", "mysql",
    "fastapi", "django", "react", "next.js", "node.js", "docker", "kubernetes", "aws", "azure", "gcp", "git",
)
MAX_BYTES = 10 * 1024 * 1024


def section_of(line: Column) -> Column:
    """The section that a heading line opens, else null."""
    heading = F.btrim(F.regexp_replace(F.lower(line), "[^a-záéíóúñ ]", ""))  # fixed value: the signs of a heading
    out = F.lit(None).cast("string")
    for section, names in SECTIONS.items():
        out = F.when(heading.isin(*names), section).otherwise(out)
    return out


def resume_sections(df: DataFrame) -> DataFrame:
    """``df(id, text)`` as non-empty lines ``(id, line_no, line, section, is_heading)``.

    Lines before the first heading belong to the summary.
    """
    lines = df.select("id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line")).filter("line <> ''").withColumn("_opens", section_of(F.col("line")))
    upto = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.coalesce(F.last("_opens", ignorenulls=True).over(upto), F.lit("summary"))
    return lines.select("id", "line_no", "line", section.alias("section"), F.col("_opens").isNotNull().alias("is_heading"))


def extract_skills(skills_text: Column, whole_text: Column) -> Column:
    """Known skills by substring in the skills section (else the text), then its other short pieces."""
    given = F.coalesce(skills_text, F.lit(""))
    source = F.lower(F.when(given != "", given).otherwise(whole_text))
    known = F.filter(F.array(*map(F.lit, KNOWN_SKILLS)), lambda s: F.contains(source, s))
    pieces = F.filter(
        F.transform(F.split(given, "[,;|•]"), lambda p: F.btrim(p)),
        lambda p: (p != "") & (F.length(p) <= 60) & ~F.array_contains(known, F.lower(p)),
    )
    # A piece counts once whatever its case.
    once = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda done, p: F.when(F.exists(done, lambda d: F.lower(d) == F.lower(p)), done).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(known, once)


def build_profiles(df: DataFrame) -> DataFrame:
    """``df(id, text)`` → ``id, name, summary, skills, experience, education, languages``; texts under 20 characters drop out."""
    cleaned = df.select("id", clean_resume_text(F.col("text")).alias("text")).filter("text is not null")
    lines = resume_sections(cleaned)
    rank = Window.partitionBy("id").orderBy("line_no")
    ranked = lines.withColumn("_n", F.row_number().over(rank))
    own = ranked.filter("not is_heading")
    place = Window.partitionBy("id", "section").orderBy("line_no")
    own = own.withColumn("_k", F.row_number().over(place))

    def held(section: str, most: int | None = None) -> Column:
        wanted = F.col("section") == section
        if most is not None:
            wanted &= F.col("_k") <= most
        rows = F.array_sort(F.collect_list(F.when(wanted, F.struct("line_no", "line"))))
        return F.transform(rows, lambda x: x["line"])

    named = F.when((F.col("_n") <= 5) & (F.length("line") <= 100), F.struct("line_no", "line"))
    found = own.groupBy("id").agg(
        F.coalesce(F.min(named)["line"], F.lit("")).alias("name"),
        F.array_join(held("summary", 3), " ").alias("summary"),
        F.array_join(held("skills"), " ").alias("_skills"),
        held("experience").alias("experience"),
        held("education").alias("education"),
        held("languages").alias("languages"),
    )
    joined = cleaned.join(found, "id", "left")
    return joined.select(
        "id", F.coalesce("name", F.lit("")).alias("name"), "summary",
        extract_skills(F.col("_skills"), F.col("text")).alias("skills"), "experience", "education", "languages",
    )


def validate_resume_files(df: DataFrame) -> DataFrame:
    """``df(name, mime, content)`` with ``error``: null for a file that may be read."""
    name, size = F.col("name"), F.length("content")
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    mime_ok = F.col("mime").isNull() | (F.col("mime") == "application/octet-stream")
    mime_ok |= (suffix == ".pdf") & (F.col("mime") == "application/pdf")
    mime_ok |= (suffix == ".docx") & (F.col("mime") == "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    error = (
        F.when(name.isNull() | (name == "") | (F.length(name) > 255) | name.rlike(r"[\x00-\x1F\x7F/\\]"), "invalid file name")
        .when(~suffix.isin(".pdf", ".docx"), "unsupported file type")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty file")
        .when(size > MAX_BYTES, "file too large")
        .when(~mime_ok, "file type does not match")
        .when((suffix == ".pdf") & (F.substring("content", 1, 5) != F.lit(b"%PDF-")), "not a PDF file")
    )
    return df.withColumn("error", error)
