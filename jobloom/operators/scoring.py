"""Compatibility scores of postings against profiles, with an explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.fields import experience_years
from jobloom.sources.scratch import materialize

# The dimensions of a score, and the name of the rules.
DIMENSIONS = ("skills", "experience", "seniority", "language", "location", "modality", "salary", "work_authorization")
RULESET = "deterministic-v1"


def tokens(c: Column) -> Column:
    """Distinct trimmed, lower-cased, non-blank values; null is empty."""
    cleaned = F.transform(c, lambda x: F.lower(F.btrim(x)))
    return F.coalesce(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def _share(have: Column, wanted: Column) -> Column:
    """Part of ``wanted`` that is in ``have``; 1 if nothing is wanted."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(have, wanted)), F.size(wanted)), F.lit(1.0))


def _one(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


# The match of each dimension, between 0 and 1, as functions of columns. Lists are ``tokens``.


def skills_match(have: Column, required: Column, desirable: Column) -> Column:
    """Seven tenths for the required skills, three for the desirable ones; 1 if none are asked for."""
    shares = 0.7 * _share(have, required) + 0.3 * _share(have, desirable)
    return F.when((F.size(required) == 0) & (F.size(desirable) == 0), 1.0).otherwise(shares)


def experience_match(years: Column, required_years: Column) -> Column:
    """The part of the required years that is there, 1 at most; nothing or 0 required: 1."""
    required = F.coalesce(required_years, F.lit(0.0))
    return F.when(required == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(years, required)))


def seniority_match(mine: Column, theirs: Column) -> Column:
    """Equality, or 1 if either is blank."""
    mine, theirs = F.lower(F.coalesce(mine, F.lit(""))), F.lower(F.coalesce(theirs, F.lit("")))
    return _one((mine == "") | (theirs == "") | (mine == theirs))


def language_match(languages: Column, preferred: Column) -> Column:
    """The part of the preferred languages that is spoken; none preferred: 1."""
    return _share(languages, preferred)


def location_match(here: Column, wanted: Column, relocates: Column) -> Column:
    """1 if no place is wanted, one of ``here`` is, or the person would move."""
    return _one((F.size(wanted) == 0) | F.arrays_overlap(here, wanted) | F.coalesce(relocates, F.lit(False)))


def modality_match(modality: Column, wanted: Column) -> Column:
    return _one((F.size(wanted) == 0) | F.array_contains(wanted, F.lower(F.coalesce(modality, F.lit("unknown")))))


def salary_match(salary_max: Column, wanted_min: Column) -> Column:
    """1 if either is unknown or enough is paid, whatever the currency and the period."""
    return _one(wanted_min.isNull() | salary_max.isNull() | (salary_max >= wanted_min))


def authorization_match(mine: Column, asked: Column) -> Column:
    return _one((F.size(mine) == 0) | (F.size(asked) == 0) | F.arrays_overlap(mine, asked))


def weighted_score(matches: dict[str, Column], weights: dict[str, Column]) -> Column:
    """100 times the weighted mean of the matches, with two decimals; weights that add up to 0 give 0."""
    total = sum(weights.values(), F.lit(0.0))
    weighted = sum((matches[d] * weights[d] for d in matches), F.lit(0.0))
    return F.round(100 * weighted / F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)), 2)


def effective_weights(df: DataFrame, preference: str = "weights", override: dict[str, float] | None = None, base: dict[str, float] | None = None) -> DataFrame:
    """``w_<dimension>``: call override, else preference, else scorer weight, else 1; only weights >= 0 count."""
    override = {k: float(v) for k, v in (override or {}).items() if k in DIMENSIONS and v >= 0}
    base = {k: float(v) for k, v in (base or {}).items() if k in DIMENSIONS and v >= 0}
    columns = {}
    for d in DIMENSIONS:
        own = F.try_element_at(F.col(preference), F.lit(d))
        stored = F.coalesce(F.when(own >= 0, own), F.lit(base.get(d, 1.0)))
        columns[f"w_{d}"] = F.lit(override[d]) if d in override else stored
    return df.withColumns(columns)


def score(pairs: DataFrame, override: dict[str, float] | None = None, base: dict[str, float] | None = None) -> DataFrame:
    """Score every pair of a posting and a profile with its preferences.

    Reads posting columns ``location, region, modality, salary_max, required_skills, desirable_skills,
    constraints, job_authorization, required_years, job_seniority`` and profile columns ``skills,
    experience, languages, preferred_languages, locations, modalities, excluded_constraints,
    work_authorization, seniority, wanted_min, willing_to_relocate, weights``. Adds ``score, breakdown,
    matches, gaps, exclusions, recommendations``. An excluded constraint sets the score to 0 and keeps
    the explanation.
    """
    lists = {
        "_have": "skills", "_required": "required_skills", "_desirable": "desirable_skills",
        "_languages": "languages", "_wanted_languages": "preferred_languages", "_places": "locations",
        "_modes": "modalities", "_excluded": "excluded_constraints", "_constraints": "constraints",
        "_auth": "work_authorization", "_job_auth": "job_authorization",
    }
    df = effective_weights(pairs, override=override, base=base)
    df = df.withColumns({k: tokens(F.col(c)) for k, c in lists.items()})
    df = df.withColumns({
        "_here": tokens(F.array("location", "region")),
        "_years": experience_years(F.col("experience")),
    })
    values = {
        "skills": skills_match(F.col("_have"), F.col("_required"), F.col("_desirable")),
        "experience": experience_match(F.col("_years"), F.col("required_years")),
        "seniority": seniority_match(F.col("seniority"), F.col("job_seniority")),
        "language": language_match(F.col("_languages"), F.col("_wanted_languages")),
        "location": location_match(F.col("_here"), F.col("_places"), F.col("willing_to_relocate")),
        "modality": modality_match(F.col("modality"), F.col("_modes")),
        "salary": salary_match(F.col("salary_max"), F.col("wanted_min")),
        "work_authorization": authorization_match(F.col("_auth"), F.col("_job_auth")),
    }
    df = df.withColumns({f"v_{d}": v for d, v in values.items()})
    weight = sum((F.col(f"w_{d}") for d in DIMENSIONS), F.lit(0.0))
    df = df.withColumn("_total", F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0)))
    asked = F.array_union("_required", "_desirable")
    df = df.withColumns({
        "_raw": weighted_score({d: F.col(f"v_{d}") for d in DIMENSIONS}, {d: F.col(f"w_{d}") for d in DIMENSIONS}),
        "matches": F.sort_array(F.array_intersect("_have", asked)),
        "gaps": F.sort_array(F.array_except(asked, "_have")),
        "exclusions": F.sort_array(F.array_intersect("_excluded", "_constraints")),
    })
    parts = [
        F.struct(
            F.col(f"w_{d}").alias("weight"),
            F.round(f"v_{d}", 4).alias("match"),
            F.round(100 * F.col(f"v_{d}") * F.col(f"w_{d}") / F.col("_total"), 2).alias("points"),
        ).alias(d)
        for d in DIMENSIONS
    ]
    for name, side in (("required", "_required"), ("desirable", "_desirable")):
        parts.append(F.struct(
            F.sort_array(side).alias("skills"), F.sort_array(F.array_except(side, "_have")).alias("gaps")
        ).alias(name))
    df = df.withColumns({
        "score": F.when(F.size("exclusions") > 0, 0.0).otherwise(F.col("_raw")),
        "breakdown": F.struct(*parts),
        "recommendations": F.transform(F.slice("gaps", 1, 5), lambda g: F.concat(F.lit("Close gap: "), g)),
    })
    dropped = [f"{p}_{d}" for p in "wv" for d in DIMENSIONS] + ["_raw", "_total", "_here", "_years", *lists]
    return df.drop(*dropped)


#: Profiles up to this many rows and bytes (as JSON) are broadcast to the postings.
BROADCAST_PROFILES, BROADCAST_BYTES = 100_000, 64 << 20


def pair(postings: DataFrame, profiles: DataFrame, preferences: DataFrame) -> DataFrame:
    """Every posting with every profile and its current preferences.

    This is the product that scoring asks for. Profiles are counted and measured first: up to
    ``BROADCAST_PROFILES`` and ``BROADCAST_BYTES`` go to every partition of the postings, more are dealt in as
    many joins of that size.
    """
    return cross(postings, profiles.join(current_preferences(preferences), "profile_id", "left"))


def broadcast_profiles(rows: DataFrame) -> DataFrame:
    """A narrow table with a row a profile, broadcast if they are few enough."""
    return rows.hint("broadcast" if rows.count() <= BROADCAST_PROFILES else "shuffle_hash")


def cross(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """The product of postings and profiles, with as many profiles at a time as may be broadcast."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, size = chosen.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    blocks = max(1, -(-n // BROADCAST_PROFILES), -(-size // BROADCAST_BYTES))
    block = F.pmod(F.xxhash64("profile_id"), F.lit(blocks))
    out = None
    for k in range(blocks):
        part = postings.crossJoin(F.broadcast(chosen.filter(block == k) if blocks > 1 else chosen))
        out = part if out is None else out.unionByName(part)
    return out


def current_preferences(preferences: DataFrame) -> DataFrame:
    """The first current preference row of each profile."""
    first = Window.partitionBy("profile_id").orderBy("preference_id")
    rows = preferences.filter("is_current").withColumn("_n", F.row_number().over(first))
    return rows.filter("_n = 1").drop("_n", "is_current", "preference_id")


def bounded_evaluation(pairs: DataFrame, most: int, order: str = "job_id") -> DataFrame:
    """The first ``most`` postings of each profile; none below 1."""
    place = Window.partitionBy("profile_id").orderBy(order)
    return pairs.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= max(most, 0)).drop("_n")


def input_fingerprint(columns: list[str], ruleset: str = RULESET, model: str = "") -> Column:
    """SHA-256 of the canonical JSON of what a score depends on."""
    return F.sha2(F.concat(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit(f"|{ruleset}|{model}")), 256)


def needs_evaluation(pairs: DataFrame, latest: DataFrame, columns: list[str], ruleset: str = RULESET, model: str = "") -> DataFrame:
    """Pairs without an evaluation of the same inputs; ``latest`` has ``job_id, profile_id, fingerprint``."""
    current = pairs.withColumn("fingerprint", input_fingerprint(columns, ruleset, model))
    before = latest.select("job_id", "profile_id", F.col("fingerprint").alias("_before"))
    joined = current.join(before, ["job_id", "profile_id"], "left")
    return joined.filter(~F.col("fingerprint").eqNullSafe(F.col("_before"))).drop("_before")


#: What a score reads of a posting, and of a profile with its preferences.
POSTING_INPUTS = (
    "title", "company", "description", "location", "region", "modality", "salary_max", "required_skills", "desirable_skills",
    "constraints", "job_authorization", "required_years", "job_seniority",
)


def side_fingerprints(postings: DataFrame, profiles: DataFrame, preferences: DataFrame, ruleset: str = RULESET, model: str = "") -> tuple[DataFrame, DataFrame]:
    """Postings, and profiles with their preferences, each with a hash of what a score reads of it (``_posting``, ``_profile``)."""
    read = [c for c in POSTING_INPUTS if c in postings.columns]
    chosen = profiles.join(current_preferences(preferences), "profile_id", "left")
    kinds = dict(chosen.dtypes)
    # The entries of a map are sorted, as equal maps may hold them in another order.
    plain = [F.array_sort(F.map_entries(c)).alias(c) if kinds[c].startswith("map") else F.col(c) for c in sorted(chosen.columns) if c != "profile_id"]
    hashed = F.sha2(F.concat(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}), F.lit(f"|{ruleset}|{model}")), 256)
    return postings.withColumn("_posting", input_fingerprint(read, ruleset, model)), chosen.withColumn("_profile", hashed)


def pair_fingerprint(posting: Column, profile: Column) -> Column:
    """The fingerprint of a pair's inputs, from those of its sides, so that each can be told from a stored evaluation."""
    return F.concat(posting, F.lit("|"), profile)


def due_pairs(postings: DataFrame, profiles: DataFrame, preferences: DataFrame, latest: DataFrame | None = None, ruleset: str = RULESET, model: str = "") -> DataFrame:
    """Pairs to score, with ``fingerprint``: those without an evaluation of the same inputs.

    ``latest(job_id, profile_id, fingerprint)`` is the newest evaluation of each pair. Both sides are hashed once. Postings
    that no evaluation knows as they are now meet all profiles, the others meet the profiles that none knows as they are now;
    and postings that lack an evaluation with one of the other profiles meet these, less the pairs that are current.
    So a run without changes makes no pair, and one with few changes makes few.
    """
    left, right = side_fingerprints(postings, profiles, preferences, ruleset, model)
    if latest is None:
        pairs = cross(left, right)
    else:
        left, right = materialize(left, "postings"), materialize(right, "profiles")
        halves = F.split("fingerprint", r"\|")
        before = latest.select("job_id", "profile_id", F.get(halves, F.lit(0)).alias("_was_posting"), F.get(halves, F.lit(1)).alias("_was_profile"))
        now = before.join(left.select("job_id", "_posting"), "job_id").join(broadcast_profiles(right.select("profile_id", "_profile")), "profile_id")
        same = (F.col("_was_posting") == F.col("_posting"), F.col("_was_profile") == F.col("_profile"))
        now = materialize(now.select("job_id", "profile_id", same[0].alias("_same_posting"), same[1].alias("_same_profile")), "latest")
        known = now.filter("_same_posting").select("job_id").distinct()
        told = materialize(now.filter("_same_profile").select("profile_id").distinct(), "profiles")
        changed, rest = left.join(known, "job_id", "left_anti"), materialize(left.join(known, "job_id", "left_semi"), "postings")
        current = now.filter("_same_posting AND _same_profile").select("job_id", "profile_id")
        done = current.groupBy("job_id").agg(F.count("*").alias("_done"))
        lacking = rest.join(done, "job_id", "left").filter(F.coalesce("_done", F.lit(0)) < told.count()).drop("_done")
        pairs = cross(changed, right).unionByName(cross(rest, right.join(told, "profile_id", "left_anti")))
        pairs = pairs.unionByName(cross(lacking, right.join(told, "profile_id", "left_semi")).join(current, ["job_id", "profile_id"], "left_anti"))
    return pairs.withColumn("fingerprint", pair_fingerprint(F.col("_posting"), F.col("_profile"))).drop("_posting", "_profile")


def explanation(breakdown: Column) -> Column:
    """A breakdown as a line of text: points and match of each dimension."""
    parts = [F.concat(F.lit(f"{d}: "), breakdown[d]["points"].cast("string"), F.lit(" (match "), breakdown[d]["match"].cast("string"), F.lit(")")) for d in DIMENSIONS]
    return F.array_join(F.array(*parts), "; ")


def overlay_narrative(scores: DataFrame, narratives: DataFrame) -> DataFrame:
    """Replace matches, gaps and recommendations where a valid narrative exists; scores never change."""
    n = narratives.select("job_id", "profile_id", *[F.col(c).alias(f"_{c}") for c in ("matches", "gaps", "recommendations", "model")])
    valid = F.col("_matches").isNotNull() & F.col("_gaps").isNotNull() & F.col("_recommendations").isNotNull() & F.col("_model").isNotNull()
    joined = scores.join(n, ["job_id", "profile_id"], "left")
    replaced = {c: F.when(valid, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("matches", "gaps", "recommendations")}
    model = F.when(valid, F.col("_model")).otherwise("deterministic-fallback")
    return joined.withColumns({**replaced, "model": model}).drop("_matches", "_gaps", "_recommendations", "_model")
