"""Tables, run logs, raw content, mirror pages, adapters."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.reconcile import PROPERTIES
from jobloom.sources.feeds import ALIASES, scan_items, union_sources
from jobloom.sources.scratch import materialize

ENTITIES = {
    "profiles": [], "preferences": [], "sources": [], "postings": ["region", "status"], "snapshots": [],
    "evaluations": [], "executions": [], "source_runs": [], "mirror_sync": [],
}


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write an entity; postings are partitioned by region and status."""
    df.write.mode(mode).partitionBy(*ENTITIES[name]).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in ENTITIES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{root}/{name}")


def write_run_log(root: str, executions: DataFrame, runs: DataFrame) -> None:
    """Append executions (with a uuid each) and their source runs.

    The executions are written with their uuid and not read from the plan again, so that each keeps one.
    """
    write_table(materialize(executions.withColumn("run_uuid", F.expr("uuid()")), "executions"), root, "executions")
    write_table(runs, root, "source_runs")


def enabled_sources(sources: DataFrame, enabled: bool | None = True) -> DataFrame:
    """Sources by name, optionally only the (not) enabled ones."""
    rows = sources if enabled is None else sources.filter(F.col("enabled") == enabled)
    return rows.orderBy("name")


def load_raw(spark: SparkSession, sources: DataFrame, folder: str) -> DataFrame:
    """``sources(source, payload, payload_path)`` → ``(source, payload)``; an inline value wins over a file in ``folder``.

    A path is that below ``folder``, with whatever signs it has; a bare name also finds a file in a subfolder if there is
    only one of that name.
    """
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    below = file_below(spark, folder, F.col("_metadata.file_path"))
    # Only named files are carried on with their text.
    files = found.select(below.alias("_path"), F.regexp_extract(below, r"([^/]+)$", 1).alias("_name"), F.col("value").alias("_text"))
    asked = sources.filter("payload is null and payload_path is not null").select("payload_path").distinct()
    by_path = asked.join(files, F.col("payload_path") == F.col("_path"))
    only = files.groupBy("_name").agg(F.count("*").alias("n"), F.min("_path").alias("_path")).filter("n = 1").select(F.col("_name").alias("payload_path"), F.col("_path").alias("_only"))
    by_name = asked.join(only, "payload_path").join(files, F.col("_only") == F.col("_path"))
    texts = by_path.select("payload_path", "_text", F.lit(0).alias("_rank")).unionByName(by_name.select("payload_path", "_text", F.lit(1).alias("_rank")))
    texts = texts.groupBy("payload_path").agg(F.min_by("_text", "_rank").alias("_text"))
    joined = sources.join(texts, "payload_path", "left")
    return joined.select("source", F.coalesce("payload", "_text").alias("payload"))


def file_below(spark: SparkSession, folder: str, path: Column) -> Column:
    """A file's path below ``folder``, from its URL-encoded whole path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    whole = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))  # a plus is itself, no blank
    return F.substr(whole, F.locate(root, whole) + F.lit(len(root)))


def scan_resume_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime", "content")


def scan_mirror_pages(raw: DataFrame) -> DataFrame:
    """``raw(json)`` → ``page_id`` and the mirror's properties as text."""
    v = F.try_parse_json("json")

    def text(prop: str):
        def joined(kind: str):
            parts = F.try_variant_get(v, f"$.properties['{prop}'].{kind}", "array<variant>")
            plain = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.plain_text", "string"), F.try_variant_get(p, "$.text.content", "string")))
            return F.nullif(F.array_join(plain, ""), F.lit(""))

        def raw_value(path: str):
            return F.try_variant_get(v, f"$.properties['{prop}'].{path}", "string")

        return F.coalesce(joined("title"), joined("rich_text"), raw_value("select.name"), raw_value("date.start"), raw_value("number"), raw_value("url"))

    return raw.select(F.try_variant_get(v, "$.id", "string").alias("page_id"), *[text(p).alias(p) for p in PROPERTIES])


class Adapter(NamedTuple):
    """How raw content of a source becomes items, the company of items that name none, and the keys under which its items send a field."""

    scan: Callable[[DataFrame], DataFrame]
    default_company: str | None = None
    aliases: dict[str, tuple[str, ...]] | None = None  #: field to keys, in the order in which they are tried; others as usual


# The adapters that are known from the start.
_ADAPTERS: dict[str, Adapter] = {
    "json-api-feed": Adapter(scan_items),
    "greenhouse-career-page": Adapter(scan_items, "Greenhouse employer"),
    "lever-career-page": Adapter(scan_items, "Lever employer"),
}


def register_adapter(name: str, scan: Callable[[DataFrame], DataFrame], default_company: str | None = None,
                     aliases: dict[str, tuple[str, ...]] | None = None) -> None:
    """Make a scan of raw content known by name."""
    if unknown := sorted(set(aliases or {}) - set(ALIASES)):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    _ADAPTERS[name] = Adapter(scan, default_company, aliases)


def adapter_aliases(spark: SparkSession) -> DataFrame:
    """``(adapter, aliases)``: the keys that adapters bring, as data; a row for each adapter that brings some."""
    rows = [(name, {f: list(keys) for f, keys in a.aliases.items()}) for name, a in _ADAPTERS.items() if a.aliases]
    return spark.createDataFrame(rows, "adapter string, aliases map<string,array<string>>")


def adapter(name: str) -> Adapter:
    return _ADAPTERS[name]


def adapter_names(spark: SparkSession) -> DataFrame:
    """``(adapter, default_company)`` of all known adapters, for routing."""
    return spark.createDataFrame([(name, a.default_company) for name, a in _ADAPTERS.items()], "adapter string, default_company string")


def scan_routed(routed: DataFrame) -> DataFrame:
    """Items of ``routed(source, adapter, base_url, default_company, payload, html)``, each source through its adapter.

    Sources without a known adapter have none. A source's own default company wins over its adapter's.
    """
    parts = []
    for name, known in _ADAPTERS.items():
        mine = routed.filter(F.col("adapter") == name)
        company = F.coalesce(F.nullif(F.col("default_company"), F.lit("")), F.lit(known.default_company))
        parts.append(known.scan(mine.withColumn("default_company", company).drop("adapter")).withColumn("adapter", F.lit(name)))
    # One plan for all adapters: the keys that an adapter brings are a column of its items.
    return union_sources(*parts).join(F.broadcast(adapter_aliases(routed.sparkSession)), "adapter", "left")
