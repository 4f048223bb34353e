"""Versions of profiles and preferences, patches, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators.segments import carried, segmented
from jobloom.sources.scratch import materialize


def preference_history(changes: DataFrame) -> DataFrame:
    """``changes(profile_id, seq, ...)`` with ``is_current`` for the last row and the profile version it made.

    A profile of very many changes is numbered in segments, each from where the ones before end.
    """
    rows = segmented(materialize(changes, "changes"), "profile_id", "seq")
    begins = carried(rows, "profile_id", "seq", {}, {"_before": F.lit(1)})
    last = rows.groupBy("profile_id").agg(F.max("segment").alias("_last"))
    rows = rows.join(begins, ["profile_id", "segment"]).join(last, "profile_id")
    line = Window.partitionBy("profile_id", "segment").orderBy("seq")
    return rows.withColumns({
        "is_current": F.lead("seq").over(line).isNull() & (F.col("segment") == F.col("_last")),
        "version": (F.col("_before") + F.row_number().over(line) + 1).cast("int"),
    }).drop("segment", "_before", "_last")


def profile_versions(patches: DataFrame, fields: list[str]) -> DataFrame:
    """``patches(profile_id, seq, fields...)``: a null field is not patched.

    Adds ``changed_dimensions`` (sorted), ``version`` (a patch that changes nothing makes none) and
    ``needs_reevaluation``. A profile of very many patches is scanned in segments twice: for the values, and then for
    the versions.
    """
    rows = segmented(materialize(patches, "patches"), "profile_id", "seq")
    begins = carried(rows, "profile_id", "seq", {f"_from_{f}": F.col(f) for f in fields})
    past = Window.partitionBy("profile_id", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("profile_id", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = {f"_{f}": F.coalesce(F.last(f, ignorenulls=True).over(past), f"_from_{f}") for f in fields}
    df = rows.join(begins, ["profile_id", "segment"]).withColumns(before)
    changed = [F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]
    df = df.withColumn("changed_dimensions", F.array_sort(F.array_compact(F.array(*changed))))
    df = df.withColumn("needs_reevaluation", F.size("changed_dimensions") > 0).drop(*before, *[f"_from_{f}" for f in fields])
    df = materialize(df, "changed")
    made = F.col("needs_reevaluation").cast("int")
    df = df.join(carried(df, "profile_id", "seq", {}, {"_made": made}), ["profile_id", "segment"])
    return df.withColumn("version", 1 + F.col("_made") + F.sum(made).over(upto)).drop("segment", "_made")


def clear_reevaluation(profiles: DataFrame, done: DataFrame) -> DataFrame:
    """Clear the marker of profiles whose current version was evaluated."""
    best = done.groupBy("profile_id", F.col("evaluated_version").alias("version")).agg(F.lit(True).alias("_done"))
    joined = profiles.join(best, ["profile_id", "version"], "left")
    clear = F.coalesce("_done", F.lit(False))
    columns = [F.when(clear, False).otherwise(F.col(c)).alias(c) if c == "needs_reevaluation" else F.col(c) for c in profiles.columns]
    return joined.select(*columns)


def reevaluation_queue(profiles: DataFrame) -> DataFrame:
    return profiles.filter("needs_reevaluation")


def upsert_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str, merge: bool = False) -> DataFrame:
    """Last write per key: whole rows replaced, or with ``merge`` only the non-null fields."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    newest = incoming.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", order)
    values = [c for c in existing.columns if c not in keys]
    new = newest.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in values])
    joined = existing.join(new, keys, "full")

    def chosen(c: str):
        if merge:
            return F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
        return F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *[chosen(c) for c in values])


def apply_patches(df: DataFrame, patches: DataFrame, key: str, given: str | None = None) -> DataFrame:
    """Change the supplied fields of the rows with a patch; an unknown field is an error.

    Supplied are the fields that are not null, or, with ``given``, those that this array column of ``patches``
    names, which may so become null. Of several patches of a row, the largest in the order of its columns counts.
    """
    fields = [c for c in patches.columns if c not in (key, given)]
    if unknown := sorted(set(fields) - set(df.columns)):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    renamed = patches.select(key, *[F.col(c).alias(f"_{c}") for c in fields], *([F.col(given).alias("_given")] if given else []))
    once = renamed.groupBy(key).agg(F.max(F.struct(*[c for c in renamed.columns if c != key])).alias("_patch"))
    joined = df.join(once, key, "left")

    def patched(c: str):
        new = F.col(f"_patch._{c}")
        if given is None:
            return F.coalesce(new, F.col(c)).alias(c)
        return F.when(F.coalesce(F.array_contains("_patch._given", c), F.lit(False)), new).otherwise(F.col(c)).alias(c)

    return joined.select(*[patched(c) if c in fields else F.col(c) for c in df.columns])


def delete_sources(sources: DataFrame, jobs: DataFrame, runs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete ``gone(source_id)``: its runs go too and its postings lose their source."""
    lost = gone.select(F.col("source_id").alias("_gone")).distinct()
    kept = jobs.join(lost, jobs.source_id == lost["_gone"], "left")
    columns = [F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "source_id" else F.col(c) for c in jobs.columns]
    ids = gone.select("source_id").distinct()
    return (
        sources.join(ids, "source_id", "left_anti"),
        kept.select(*columns),
        runs.join(ids, "source_id", "left_anti"),
    )
