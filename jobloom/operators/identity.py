"""Identity of postings: matching, survivorship, content history, missing postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.links import canonicalize_url, content_hash
from jobloom.operators.components import connected_components
from jobloom.operators.segments import carried, segmented
from jobloom.sources.scratch import materialize


def resolve_identity(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``job_id`` of the existing row with the same URL, else with the same fingerprint, and a conflict flag.

    Two equi joins; ``identity_conflict`` marks rows whose URL and fingerprint belong to two postings. Of stored
    rows with the same URL or fingerprint the smallest ``job_id`` counts, so that an incoming row stays one row.
    """
    by_url = existing.groupBy("canonical_url").agg(F.min("job_id").alias("_by_url"))
    by_print = existing.groupBy("fingerprint").agg(F.min("job_id").alias("_by_print"))
    joined = incoming.join(by_url, "canonical_url", "left").join(by_print, "fingerprint", "left")
    return joined.select(
        *incoming.columns,
        F.coalesce("_by_url", "_by_print").alias("job_id"),
        F.coalesce(F.col("_by_url") != F.col("_by_print"), F.lit(False)).alias("identity_conflict"),
    )


def identity_components(rows: DataFrame) -> DataFrame:
    """Add ``identity``: the smallest ``seq`` reachable over equal URLs or equal fingerprints."""
    edges = []
    # Written once: keys are read four times, and making them from links and texts is the dearest part.
    keys = materialize(rows.select("seq", "canonical_url", "fingerprint"), "keys")
    for key in ("canonical_url", "fingerprint"):
        # A table: the rows of a hot key are then a skewed partition that Spark can split.
        first = materialize(keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("a")), "first")
        edges.append(keys.join(first, key).select("a", F.col("seq").alias("b")))
    found = connected_components(edges[0].unionByName(edges[1]))
    joined = rows.join(found, rows.seq == found.node, "left")
    return joined.select(*rows.columns, F.coalesce("component", "seq").alias("identity"))


def useful(c: Column) -> Column:
    return c.isNotNull() & ~F.coalesce(c.cast("string"), F.lit("")).isin("", "unknown", "other")


def merge_postings(versions: DataFrame, fields: list[str], identity: str = "identity", order: str = "seq") -> DataFrame:
    """One row per identity: of every field the last useful value, else the last value.

    Also keeps the first non-null ``source_id`` and counts the sightings.
    """
    seq = F.col(order)
    merged = []
    for f in fields:
        c = F.col(f)
        last = F.max(F.struct(seq, c.alias("x")))["x"]
        best = F.max(F.when(useful(c), F.struct(seq, c.alias("x"))))["x"]
        merged.append(F.coalesce(best, last).alias(f))
    if "source_id" in versions.columns:
        s = F.col("source_id")
        merged.append(F.min(F.when(s.isNotNull(), F.struct(seq, s.alias("x"))))["x"].alias("source_id"))
    return versions.groupBy(identity).agg(*merged, F.count("*").alias("sightings"))


def merge_metadata(versions: DataFrame, column: str, identity: str = "identity", order: str = "seq") -> DataFrame:
    """Shallow merge of maps, later ones win."""
    keyed = versions.select(identity, order, F.explode_outer(column).alias("k", "v")).filter("k is not null")
    last = keyed.groupBy(identity, "k").agg(F.max(F.struct(order, "v"))["v"].alias("v"))
    return last.groupBy(identity).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column)
    )


def snapshots(versions: DataFrame, identity: str = "identity", order: str = "seq") -> DataFrame:
    """Earlier contents of each identity, one row per distinct content that was replaced.

    An identity of very many versions is scanned in segments: each begins with the last values of the ones before.
    """
    fields = ["description", "description_url", "application_url"]
    said = [F.when(F.col(f) != "", F.col(f)).alias(f) for f in fields]
    rows = materialize(versions.select(identity, order, *said), "versions")
    rows = segmented(rows, identity, order)
    begins = carried(rows, identity, order, {f"_from_{f}": F.col(f) for f in fields})
    past = Window.partitionBy(identity, "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = Window.partitionBy(identity, "segment").orderBy(order)
    rows = rows.join(begins, [identity, "segment"])
    filled = rows.select(identity, order, "segment", *[F.coalesce(F.last(f, ignorenulls=True).over(past), f"_from_{f}").alias(f) for f in fields],
                         *[f"_from_{f}" for f in fields], F.row_number().over(line).alias("_place"))
    own, start = content_hash(*[F.col(f) for f in fields]), content_hash(*[F.col(f"_from_{f}") for f in fields])
    filled = filled.withColumns({"content_hash": own, "_start_hash": start})
    # The first row of a segment follows what the segment began with, of a key's first segment nothing.
    opening = F.col("_place") == 1
    before = {f"_{c}": F.when(~opening, F.lag(c).over(line)).when(F.col("segment") > 0, F.col(f"_from_{c}")) for c in fields}
    before["_content_hash"] = F.when(~opening, F.lag("content_hash").over(line)).when(F.col("segment") > 0, F.col("_start_hash"))
    changed = filled.withColumns(before).filter("_content_hash is not null and _content_hash <> content_hash")
    rows = changed.select(identity, F.col(order).alias("replaced_at"), *[F.col(f"_{c}").alias(c) for c in [*fields, "content_hash"]])
    # All rows of a content are equal but for the place, so the first is a smallest struct.
    first = rows.groupBy(identity, "content_hash").agg(F.min(F.struct("replaced_at", *fields)).alias("_first"))
    return first.select(identity, "_first.replaced_at", *[f"_first.{f}" for f in fields], "content_hash")


def mark_missing(jobs: DataFrame, seen: DataFrame, source_id: int) -> DataFrame:
    """``jobs`` with active postings of a source inactive when their URL is not among ``seen(url)``.

    ``marked`` tells which rows changed, so their number is a count of it.
    """
    urls = seen.select(canonicalize_url(F.col("url")).alias("canonical_url")).dropna().distinct()
    hit = jobs.join(urls.withColumn("_seen", F.lit(True)), "canonical_url", "left")
    gone = (F.col("status") == "active") & (F.col("source_id") == source_id) & F.col("_seen").isNull()
    gone = F.coalesce(gone, F.lit(False))
    columns = [F.when(gone, "inactive").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in jobs.columns]
    return hit.select(*columns, gone.alias("marked"))


def mark_missing_of_sources(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """``mark_missing`` for all sources at once, by ``seen(source, url)``; postings of other sources stay as they are."""
    links = seen.select("source", canonicalize_url(F.col("url")).alias("canonical_url"), F.lit(True).alias("_seen")).dropna().distinct()
    ran = seen.select("source", F.lit(True).alias("_ran")).distinct()
    hit = jobs.join(links, ["source", "canonical_url"], "left").join(ran, "source", "left")
    gone = F.coalesce((F.col("status") == "active") & F.col("_ran") & F.col("_seen").isNull(), F.lit(False))
    columns = [F.when(gone, "inactive").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in jobs.columns]
    return hit.select(*columns, gone.alias("marked"))


def dedup_run(rows: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """One row per posting: the position of the first, the values of the last."""
    others = [c for c in rows.columns if c not in (key, order)]
    last = F.max_by(F.struct(*[F.col(c) for c in others]), order).alias("_last")
    merged = rows.groupBy(key).agg(F.max(order).alias(order), F.min(order).alias("position"), last)
    return merged.select(*[f"_last.{c}" if c in others else c for c in rows.columns], "position")
