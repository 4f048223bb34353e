"""Postings that keep their identity, status and history over many runs.

A ledger has three tables: ``keys`` (a canonical URL or a fingerprint, and the posting it belongs to), ``aliases``
(postings that were found to be another one) and ``states`` (what is known of each posting). A batch of sightings meets
``keys`` by equality, so only what it touches is joined, folded and written. Ids are minted once, in the order of first
sightings, and never change; when sightings connect postings, the smallest id stays and the others become its aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobloom.operators.components import connected_components
from jobloom.operators.identity import useful
from jobloom.operators.numbering import number_rows
from jobloom.sources.scratch import materialize
from jobloom.sources.store import BucketStore, Manifest

KEYS, ALIASES = "key string, job_id long", "old_id long, job_id long"
#: The column that deals the rows of each table.
LEDGER = {"keys": "key", "aliases": "old_id", "states": "job_id"}
#: How states are written; it stands with the versions.
FORMAT = 2
#: Ids of postings are below it.
_ROWS = 1 << 62


def key_columns() -> list[Column]:
    """The keys of a sighting: its URL, and its fingerprint. One without either is its own."""
    url, printed = F.concat(F.lit("u|"), "canonical_url"), F.concat(F.lit("f|"), "fingerprint")
    return [F.coalesce(url, F.when(F.col("fingerprint").isNull(), F.concat(F.lit("s|"), F.col("seq").cast("string")))), printed]


def numbered_sightings(sightings: DataFrame) -> DataFrame:
    """``sightings`` with a number of their own, ``_row``, written once."""
    return materialize(sightings.withColumn("_row", F.monotonically_increasing_id()), "batch")


def _each_key(keyed: DataFrame) -> DataFrame:
    return keyed.select("_row", F.explode(F.array_compact(F.array(*key_columns()))).alias("key"))


def assign_ids(keyed: DataFrame, known: DataFrame, aliases: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(_row, job_id)`` of ``numbered_sightings()``, new ``(key, job_id)``, and ``(old_id, job_id)`` of postings that are found to be one.

    ``known(key, job_id)`` are the keys in use, of which only those of the sightings need be given, and ``aliases(old_id,
    job_id)`` what became of their postings. Sightings that share a URL or a fingerprint, over any number of steps, are one posting.

    A key stands for its posting or, if it is new, for the first row that has it; only rows whose two keys stand for
    different ones make an edge, of two numbers. Postings are numbers below zero, so that they come before rows.
    """
    now = F.coalesce("_now", "job_id").alias("job_id")
    nodes = _each_key(keyed).groupBy("key").agg(F.min("_row").alias("_first")).join(known, "key", "left")
    nodes = nodes.join(aliases.select(F.col("old_id").alias("_old"), F.col("job_id").alias("_now")), F.col("job_id") == F.col("_old"), "left").select("key", "_first", now)
    nodes = materialize(nodes.select("key", (F.col("job_id") - _ROWS).alias("_posting"), F.coalesce(F.col("job_id") - _ROWS, "_first").alias("node")), "nodes")
    ends = _each_key(keyed).join(nodes.select("key", "node"), "key").groupBy("_row").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    ends = materialize(ends, "ends")
    found = connected_components(ends.select("a", "b"))
    held = ends.join(found, ends.a == found.node, "left").select("_row", F.coalesce("component", "a").alias("component"))
    held = materialize(held, "held")
    minted = held.filter("component >= 0").join(keyed.select("_row", "seq"), "_row").groupBy("component").agg(F.min("seq").alias("seq"))
    minted = number_rows(minted, ["seq"], "new_id", first=next_id).select("component", "new_id")
    named = held.join(minted, "component", "left").select("_row", F.coalesce("new_id", F.col("component") + _ROWS).alias("job_id"))
    named = materialize(named, "named")
    fresh = nodes.filter("_posting is null").join(named, F.col("node") == F.col("_row")).select("key", "job_id")
    merged = found.filter("node < 0 and node <> component").select((F.col("node") + _ROWS).alias("old_id"), (F.col("component") + _ROWS).alias("job_id"))
    return named, fresh, merged


def sighting_states(assigned: DataFrame, fields: list[str]) -> DataFrame:
    """Each sighting as the state of a posting seen once: the last values, and of each field the last useful one with its place.

    A useful value is written with its place only if it is not among the last values.
    """
    seq, kinds = F.col("seq"), dict(assigned.dtypes)
    columns = [F.lit(1).cast("long").alias("sightings"), seq.alias("first_seq"), seq.alias("seen_seq"), F.lit(None).cast(kinds["seq"]).alias("missing_seq")]
    best = [F.lit(None).cast(f"struct<seq:{kinds['seq']},x:{kinds[f]}>").alias(f"best_{f}") for f in fields]
    source = F.when(F.col("source").isNotNull(), F.struct(seq, F.col("source").alias("x"))).alias("first_source")
    meta = F.transform_values("metadata", lambda _, value: F.struct(seq, value.alias("x"))).alias("meta")
    merged = F.lit(False).alias("identity_conflict")
    return assigned.select("job_id", *columns, F.struct(*fields).alias("last"), *best, source, F.col("checked_at").alias("checked_at"), merged, meta)


def fold_states(rows: DataFrame) -> DataFrame:
    """States of the same posting made one, in any order and grouping: each part is a largest, a smallest or a sum."""
    fields = [c.removeprefix("best_") for c in rows.columns if c.startswith("best_")]

    def best(f: str) -> Column:
        x = F.col("last")[f]
        return F.coalesce(f"best_{f}", F.when(useful(x), F.struct(F.col("seen_seq").alias("seq"), x.alias("x"))))

    folded = rows.groupBy("job_id").agg(
        F.sum("sightings").alias("sightings"), F.min("first_seq").alias("first_seq"), F.min("first_source").alias("first_source"),
        F.max(F.struct("seen_seq", "last")).alias("_seen"), *[F.max(best(f)).alias(f"best_{f}") for f in fields],
        *[F.max(c).alias(c) for c in ("missing_seq", "checked_at", "identity_conflict")],
    )
    folded = folded.select("*", "_seen.seen_seq", "_seen.last")
    folded = folded.withColumns({f"best_{f}": F.when(~useful(F.col("last")[f]), F.col(f"best_{f}")) for f in fields})
    entries = rows.filter("meta is not null").select("job_id", F.explode("meta").alias("k", "v")).groupBy("job_id", "k").agg(F.max("v").alias("v"))
    meta = entries.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
    return folded.join(meta, "job_id", "left").select(*rows.columns)


def status(reactivate: bool = False) -> Column:
    """``active`` until a posting is missing; it stays ``inactive`` when it is seen again, unless ``reactivate``."""
    gone = F.col("missing_seq").isNotNull()
    if reactivate:
        gone &= F.col("missing_seq") > F.col("seen_seq")
    return F.when(gone, "inactive").otherwise("active")


def postings_of(states: DataFrame, reactivate: bool = False) -> DataFrame:
    """States as postings: the useful values, metadata, source, status, checks and how often they were seen."""
    fields = [c.removeprefix("best_") for c in states.columns if c.startswith("best_")]
    return states.select(
        "job_id", *[F.coalesce(F.col(f"best_{f}")["x"], F.col("last")[f]).alias(f) for f in fields],
        F.transform_values("meta", lambda _, v: v["x"]).alias("metadata"), F.col("first_source")["x"].alias("source"),
        status(reactivate).alias("status"), "checked_at", "identity_conflict", "sightings", "first_seq", "seen_seq", "missing_seq",
    )


def status_after(events: DataFrame, key: str, order: str, seen: Column, reactivate: bool = False) -> DataFrame:
    """``key, status, seen, missed`` by the events of each key: sightings (``seen``), and checks that missed it.

    A fold of the last places of both kinds, so that a key of any size is summed up where it is read. A miss before
    the first sighting counts for nothing.
    """
    at = F.col(order)
    first = events.filter(seen).groupBy(key).agg(F.min(at).alias("_first"))
    rows = events.join(first, key)
    missed = ~seen & (at > F.col("_first"))
    folded = rows.groupBy(key).agg(
        F.max(F.when(seen, at)).alias("seen_seq"), F.max(F.when(missed, at)).alias("missing_seq"), F.count_if(seen).alias("seen"), F.count_if(missed).alias("missed")
    )
    return folded.select(key, status(reactivate).alias("status"), "seen", "missed")


class Ledger:
    """The postings of many runs in a store of buckets."""

    def __init__(self, store: BucketStore, fields: list[str], kinds: StructType):
        """``kinds`` has the types of ``fields``, ``seq``, ``source``, ``metadata`` and ``checked_at``."""
        self.store, self.fields, self.kinds = store, fields, kinds
        nothing = store.spark.createDataFrame([], StructType([*kinds.fields, StructField("job_id", LongType())]))
        self.schema = sighting_states(nothing, fields).schema

    def _states(self, manifest: Manifest, touched: list[int] | None = None) -> DataFrame:
        if manifest.get("states") and manifest.get("format") != {0: FORMAT}:
            raise ValueError(f"{self.store.root} has states of another format; ingest its sightings anew")
        return self.store.read("states", self.schema, manifest, touched)

    def postings(self, reactivate: bool = False) -> DataFrame:
        """The current postings."""
        return postings_of(self.states(), reactivate)

    def states(self) -> DataFrame:
        return self._states(self.store.manifest())

    def aliases(self) -> DataFrame:
        """``(old_id, job_id)``: what became of ids that are no longer in use."""
        return self.store.read("aliases", ALIASES, self.store.manifest())

    def ingest(self, sightings: DataFrame, number: int) -> None:
        """Add a batch of sightings as update ``number``; run again, it gives the same ledger."""
        store, manifest = self.store, self.store.manifest(before=number)
        batch = numbered_sightings(sightings.select(*self.kinds.fieldNames()))
        touched = store.touched("keys", _each_key(batch))
        held = store.read("keys", KEYS, manifest, touched)
        aliases = store.read("aliases", ALIASES, manifest)
        # Ids are never used again: the next one stands with the versions.
        next_id = manifest.get("next_id", {0: 1})[0]
        named, fresh, merged = assign_ids(batch, held, aliases, next_id)
        merged = materialize(merged, "merged")
        manifest["next_id"] = {0: max(next_id, 1 + (named.agg(F.max("job_id")).first()[0] or 0))}
        store.replace("keys", number, held.unionByName(fresh), touched, manifest)
        # What becomes of the postings that the batch touches; those that others join have sightings in it.
        stays = named.select("job_id", F.col("job_id").alias("_now")).distinct()
        ids = materialize(stays.unionByName(merged.select(F.col("old_id").alias("job_id"), F.col("job_id").alias("_now"))), "ids")
        touched = store.touched("states", ids)
        old = self._states(manifest, touched)
        stay = old.join(ids, "job_id", "left_anti")
        # A posting that becomes part of another brings its values, and its status only counts if it is the one that stays.
        joins = F.col("job_id") != F.col("_now")
        change = old.join(ids, "job_id").withColumns({
            "missing_seq": F.when(~joins, F.col("missing_seq")), "job_id": F.col("_now"), "identity_conflict": F.col("identity_conflict") | joins,
        }).select(*self.schema.fieldNames())
        new = sighting_states(batch.join(named, "_row"), self.fields)
        store.replace("states", number, stay.unionByName(fold_states(change.unionByName(new))), touched, manifest)
        manifest["format"] = {0: FORMAT}
        if not merged.isEmpty():
            # Aliases of what is now an alias point on; there are as many as postings were ever joined.
            moved = merged.select(F.col("old_id").alias("_old"), F.col("job_id").alias("_now"))
            kept = aliases.join(moved, F.col("job_id") == F.col("_old"), "left").select("old_id", F.coalesce("_now", "job_id").alias("job_id"))
            every = materialize(kept.unionByName(merged), "aliases")
            store.replace("aliases", number, every, list(range(store.buckets)), manifest)
        store.publish(number, manifest)

    def miss(self, missing: DataFrame, place: str, number: int) -> None:
        """Mark ``missing(job_id)`` as not found by a check at ``place`` (a sequence text), as update ``number``."""
        store, manifest = self.store, self.store.manifest(before=number)
        ids = materialize(missing.select("job_id").distinct(), "missing")
        touched = store.touched("states", ids)
        old = self._states(manifest, touched)
        marked = old.join(ids.withColumn("_gone", F.lit(True)), "job_id", "left")
        at = F.when(F.col("_gone"), F.greatest(F.lit(place), F.coalesce("missing_seq", F.lit("")))).otherwise(F.col("missing_seq"))
        store.replace("states", number, marked.withColumn("missing_seq", at).select(*self.schema.fieldNames()), touched, manifest)
        store.publish(number, manifest)
