"""Identity over runs, buckets, numbering, segments and pairs that are due."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobloom.operators import history, identity, ledger, scoring, segments
from jobloom.operators.numbering import number_rows
from jobloom.sources.store import BucketStore

KINDS = "seq string, source string, title string, description string, canonical_url string, fingerprint string, metadata map<string,string>, checked_at timestamp"


def book(spark, root, buckets=8):
    return ledger.Ledger(BucketStore(spark, str(root), ledger.LEDGER, buckets), ["title", "description", "canonical_url"], StructType.fromDDL(KINDS))


def sighting(k, url, printed, text="text", **meta):
    return (f"{k:06d}", "s", f"T{k}", text, url, printed, meta or None, None)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), KINDS)


def plain_groups(rows):
    """Sightings that share a URL or a fingerprint, by plain union."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for seq, _, _, _, url, printed, *_ in rows:
        for key in (url and f"u{url}", printed and f"f{printed}"):
            if key:
                parent[root(key)] = root(f"s{seq}")
    groups = {}
    for seq, *_ in rows:
        groups.setdefault(root(f"s{seq}"), []).append(seq)
    return {min(g): len(g) for g in groups.values()}


def test_ids_are_minted_once_and_merged_as_aliases(spark, tmp_path):
    found = book(spark, tmp_path)
    found.ingest(batch(spark, sighting(1, "a", "f1", a="1", b="1"), sighting(2, "b", "f2"), sighting(3, None, None)), 0)
    first = {r.first_seq: r.job_id for r in found.postings().collect()}
    assert sorted(first.values()) == [1, 2, 3]
    found.ingest(batch(spark, sighting(4, "a", "f9", "", b="2"), sighting(5, "c", "f5")), 1)
    assert {r.first_seq: r.job_id for r in found.postings().collect()} == {**first, "000005": 4}
    found.ingest(batch(spark, sighting(6, "b", "f9", "unknown"), sighting(7, "c", "f5", "new")), 2)  # connects 1 and 2
    rows = {r.job_id: r for r in found.postings().collect()}
    assert set(rows) == {1, 3, 4} and rows[1].sightings == 4 and rows[1].description == "text" and rows[1].metadata == {"a": "1", "b": "2"}
    assert rows[1].identity_conflict and not rows[4].identity_conflict and rows[4].description == "new"
    assert [tuple(r) for r in found.aliases().collect()] == [(2, 1)]
    found.ingest(batch(spark, sighting(8, None, "f2"), sighting(9, "z", "f0")), 3)  # a key of the alias
    rows = {r.job_id: r.sightings for r in found.postings().collect()}
    assert rows == {1: 5, 3: 1, 4: 2, 5: 1}


def test_batches_equal_one_merge_and_may_run_again(spark, tmp_path):
    rng = random.Random(3)
    rows = [sighting(k, f"u{rng.randrange(60)}" if rng.random() < 0.8 else None, f"p{rng.randrange(60)}" if rng.random() < 0.8 else None) for k in range(120)]
    found = book(spark, tmp_path)
    for n in range(3):
        found.ingest(batch(spark, *rows[40 * n : 40 * n + 40]), n)
        assert {r.first_seq: r.sightings for r in found.postings().collect()} == plain_groups(rows[: 40 * n + 40])
    before = sorted(map(tuple, found.states().drop("meta").collect()), key=str)
    found.ingest(batch(spark, *rows[80:]), 2)
    assert sorted(map(tuple, found.states().drop("meta").collect()), key=str) == before


def test_an_update_writes_only_the_buckets_it_touches(spark, tmp_path):
    found = book(spark, tmp_path, buckets=32)
    found.ingest(batch(spark, *[sighting(k, f"u{k}", f"p{k}") for k in range(300)]), 0)
    found.ingest(batch(spark, sighting(900, "u7", "p7")), 1)
    assert len(os.listdir(tmp_path / "states" / "version=0")) > 20
    for name, most in (("keys", 2), ("states", 1)):
        written = [d for d in os.listdir(tmp_path / name / "version=1") if d.startswith("bucket=")]
        assert 1 <= len(written) <= most
    # A reader sees an update only when its manifest is in place.
    os.rename(tmp_path / "manifests" / f"{1:012d}.json", tmp_path / "late")
    assert {r.sightings for r in found.postings().collect()} == {1}
    os.rename(tmp_path / "late", tmp_path / "manifests" / f"{1:012d}.json")
    assert {r.sightings for r in found.postings().collect()} == {1, 2} and found.postings().count() == 300


def test_a_batch_contracts_and_writes_only_what_it_must(spark, tmp_path, monkeypatch):
    """Edges are pairs of numbers of rows whose keys differ in their posting; a state holds its last values once; a task writes one bucket."""
    made = []
    contract = ledger.connected_components
    monkeypatch.setattr(ledger, "connected_components", lambda edges: made.append(edges.filter("a <> b")) or contract(edges))
    found = book(spark, tmp_path, buckets=16)
    found.ingest(batch(spark, *[sighting(k, f"u{k}", f"p{k}") for k in range(200)]), 0)
    # Three known postings are seen again, two of them become one, and one has a new fingerprint.
    found.ingest(batch(spark, sighting(900, "u7", "p7"), sighting(901, "u8", "p9"), sighting(902, "u10", "new", "unknown")), 1)
    assert [edges.count() for edges in made] == [0, 2] and {kind for edges in made for _, kind in edges.dtypes} == {"bigint"}
    assert "last" in found.states().columns and not [c for c in found.states().columns if c.startswith("last_")]
    states = {r.first_seq: r for r in found.states().collect()}
    assert states["000007"].best_description is None and states["000010"].best_description.x == "text" and states["000010"].last.description == "unknown"
    rows = {r.first_seq: (r.sightings, r.title, r.description, r.identity_conflict) for r in found.postings().collect() if r.sightings > 1}
    assert rows == {"000007": (2, "T900", "text", False), "000008": (3, "T901", "text", True), "000010": (2, "T902", "text", False)}
    files = [p for d in (tmp_path / "states" / "version=0").glob("bucket=*") for p in os.listdir(d) if p.endswith(".parquet")]
    assert len(files) == 16 == len({p.split("-")[1] for p in files})


def test_states_of_another_format_are_not_read(spark, tmp_path):
    found = book(spark, tmp_path)
    found.ingest(batch(spark, sighting(1, "a", "f1")), 0)
    held = found.store.manifest()
    del held["format"]
    found.store.publish(1, held)
    with pytest.raises(ValueError, match="another format"):
        found.postings()


def test_a_missing_posting_stays_inactive_when_it_is_found_again(spark, tmp_path):
    found = book(spark, tmp_path)
    found.ingest(batch(spark, sighting(1, "a", "f1"), sighting(2, "b", "f2")), 0)
    found.miss(spark.createDataFrame([(1,), (1,), (77,)], "job_id long"), "000003", 1)
    found.ingest(batch(spark, sighting(4, "a", "f1"), sighting(5, "b", "f2")), 2)
    assert {r.job_id: r.status for r in found.postings().collect()} == {1: "inactive", 2: "active"}
    assert {r.job_id: r.status for r in found.postings(reactivate=True).collect()} == {1: "active", 2: "active"}
    events = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (2, 2, False), (2, 3, True), (3, 1, False)], "k int, at int, seen boolean")
    got = {r.k: (r.status, r.seen, r.missed) for r in ledger.status_after(events, "k", "at", F.col("seen")).collect()}
    assert got == {1: ("active", 1, 0), 2: ("inactive", 2, 1)}


def test_numbers_are_gapless_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if k % 3 else "hot", rng.randrange(40) if k % 5 else None, k) for k in range(2000)]
    got = number_rows(spark.createDataFrame(rows, "source string, item_idx int, k int"), ["source", "item_idx"], "n").collect()
    got.sort(key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, 2001)) and {r.k for r in got} == set(range(2000))
    order = [(r.source, r.item_idx is not None, r.item_idx or 0) for r in got]
    assert order == sorted(order)
    assert number_rows(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_a_hot_key_is_scanned_in_segments(spark, monkeypatch):
    """Results do not depend on how a key is cut."""
    rng = random.Random(2)
    rows = [(1 if k % 3 else k % 7 + 2, k, rng.choice(["x", "y", "", None]), rng.choice(["u", None]), None, rng.choice(["p", "q", None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "identity int, seq int, description string, description_url string, application_url string, f string")
    people = df.withColumnRenamed("identity", "profile_id").select("profile_id", "seq", "f", "description")

    def results():
        parts = segments.segmented(df, "identity", "seq").groupBy("identity").agg(F.countDistinct("segment").alias("n")).collect()
        made = [identity.snapshots(df), history.profile_versions(people, ["f", "description"]), history.preference_history(people)]
        return {r.identity: r.n for r in parts}, [sorted(map(str, (m.select(*sorted(m.columns)).collect()))) for m in made]

    whole, expected = results()
    assert set(whole.values()) == {1}
    monkeypatch.setattr(segments, "SEGMENT_ROWS", 150)
    cut, got = results()
    assert cut[1] > 8 and got == expected
    # Plain scan of the hot key.
    last, version = {}, 1
    wanted = {}
    for _, seq, text, _, _, f in (r for r in rows if r[0] == 1):
        changed = sorted(n for n, x in (("f", f), ("description", text)) if x is not None and last.get(n) != x)
        last |= {n: x for n, x in (("f", f), ("description", text)) if x is not None}
        version += bool(changed)
        wanted[seq] = (changed, version)
    versions = history.profile_versions(people, ["f", "description"]).filter("profile_id = 1").collect()
    assert {r.seq: (r.changed_dimensions, r.version) for r in versions} == wanted


JOBS = "job_id int, title string, location string, region string, modality string, salary_max double, required_skills array<string>, desirable_skills array<string>, constraints array<string>, job_authorization array<string>, required_years double, job_seniority string"
PEOPLE = "profile_id int, skills array<string>, experience array<struct<years:double,years_experience:double,duration_years:double,text:string>>, languages array<string>"
WISHES = "profile_id int, preference_id int, is_current boolean, preferred_languages array<string>, locations array<string>, modalities array<string>, excluded_constraints array<string>, work_authorization array<string>, seniority string, wanted_min double, willing_to_relocate boolean, weights map<string,double>"


def test_only_changed_sides_are_paired(spark):
    def tables(job_title=None, skill=None):
        jobs = [(k, job_title if job_title and k == 1 else f"T{k}", "x", "usa", "remote", 1.0, ["a"], [], [], [], None, None) for k in range(6)]
        people = [(p, [skill if skill and p == 2 else "a"], [], []) for p in range(4)]
        wishes = [(p, 1, True, [], [], [], [], [], None, None, False, {"skills": 2.0, "salary": 1.0}) for p in range(4)]
        return spark.createDataFrame(jobs, JOBS), spark.createDataFrame(people, PEOPLE), spark.createDataFrame(wishes, WISHES)

    def pairs(df):
        return {(r.job_id, r.profile_id) for r in df.select("job_id", "profile_id").collect()}

    jobs, people, wishes = tables()
    first = scoring.due_pairs(jobs, people, wishes)
    done = first.select("job_id", "profile_id", "fingerprint").cache()
    assert len(pairs(first)) == 24 and done.count() == 24
    assert pairs(scoring.due_pairs(*tables(), done)) == set()
    assert pairs(scoring.due_pairs(*tables("new"), done)) == {(1, p) for p in range(4)}
    assert pairs(scoring.due_pairs(*tables(skill="b"), done)) == {(k, 2) for k in range(6)}
    assert pairs(scoring.due_pairs(*tables("new", "b"), done)) == {(1, p) for p in range(4)} | {(k, 2) for k in range(6)}
    holes = done.filter("NOT (job_id = 3 AND profile_id IN (0, 1))")
    assert pairs(scoring.due_pairs(*tables(), holes)) == {(3, 0), (3, 1)}
    assert pairs(scoring.due_pairs(*tables(skill="b"), holes)) == {(3, 0), (3, 1)} | {(k, 2) for k in range(6)}
    assert pairs(scoring.due_pairs(jobs, people, wishes, done.limit(0))) == pairs(first)
    assert pairs(scoring.due_pairs(jobs, people, wishes, done, model="m")) == pairs(first)
    made = scoring.score(scoring.due_pairs(*tables("new"), done)).filter("profile_id = 0").first()
    assert scoring.explanation(F.col("breakdown")) is not None and made.score == 100
