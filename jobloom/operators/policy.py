"""Sources: routing, configuration checks, crawl policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.links import HTTP

KINDS = {"api": "json-api-feed", "feed": "json-api-feed"}  # fixed values: adapters by kind


def _provider(c: Column, name: str, host: str) -> Column:
    hostname = F.lower(F.regexp_extract("base_url", r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.lower(c).contains(name) | F.lower(F.coalesce("provider", F.lit(""))).contains(name) | (hostname == host) | hostname.endswith(f".{host}")


def route_sources(sources: DataFrame, adapters: DataFrame) -> DataFrame:
    """Add ``adapter`` to ``sources(name, kind, base_url, provider, adapter_override)``, null if none fits.

    An override counts alone; else the source name, the adapter of the kind, the kind itself; else the
    narrow rules for two providers.
    """
    known = adapters.select("adapter").distinct()
    by_kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind")) if KINDS else F.lit(None)
    by_kind = F.when(F.col("kind").isin(*KINDS), by_kind)
    provider = (
        F.when(_provider(F.col("name"), "greenhouse", "greenhouse.io"), "greenhouse-career-page")
        .when(_provider(F.col("name"), "lever", "lever.co"), "lever-career-page")
    )
    plain = F.col("adapter_override").isNull()
    candidates = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("adapter_override").alias("adapter")),
        F.struct(F.lit(1).alias("rank"), F.when(plain, F.col("name")).alias("adapter")),
        F.struct(F.lit(2).alias("rank"), F.when(plain, by_kind).alias("adapter")),
        F.struct(F.lit(3).alias("rank"), F.when(plain, F.col("kind")).alias("adapter")),
        F.struct(F.lit(4).alias("rank"), F.when(plain, provider).alias("adapter")),
    )
    tried = sources.select("name", F.explode(candidates).alias("c")).select("name", "c.*").filter("adapter is not null")
    hit = tried.join(known, "adapter").groupBy("name").agg(F.min(F.struct("rank", "adapter"))["adapter"].alias("adapter"))
    return sources.join(hit, "name", "left")


def validate_sources(routed: DataFrame) -> DataFrame:
    """Add ``violations`` (field, message, type) to routed sources with ``base_url, terms_url, terms_accepted, config``.

    The limits ``timeout_seconds, requests_per_minute, max_retries`` are checked where they are columns.
    """
    def violation(bad: Column, field: str, message: Column | str, kind: str = "value_error") -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), text.alias("message"), F.lit(kind).alias("type")))

    def bad_url(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.col(c).rlike(r"^https?://[^/?#]+")

    def of(key: str) -> Column:
        return F.try_element_at("config", F.lit(key))

    network = F.coalesce(of("allow_network") == "true", F.lit(False))
    feed = F.col("adapter") == "json-api-feed"
    empty = F.lit("")
    has_fixture = F.when(feed, F.coalesce(F.nullif(of("payload"), empty), F.nullif(of("payload_path"), empty))).otherwise(
        F.coalesce(F.nullif(of("html"), empty), F.nullif(of("html_path"), empty))
    )
    unknown = F.when(of("adapter").isNotNull(), F.concat(F.lit("No adapter configured for adapter "), of("adapter"))).otherwise(
        F.concat(F.lit("No adapter configured for source name "), "name", F.lit(" or kind "), "kind")
    )
    fixture = F.when(feed, "provide payload or payload_path or set allow_network=True").otherwise(
        "provide html or html_path or set allow_network=True"
    )
    # The messages of these checks.
    limits = {
        "timeout_seconds": (F.col("timeout_seconds") <= 0, "timeout_seconds must be greater than zero"),
        "requests_per_minute": (F.col("requests_per_minute") <= 0, "requests_per_minute must be greater than zero"),
        "max_retries": (F.col("max_retries") < 0, "max_retries cannot be negative"),
    }
    checks = [
        violation(bad_url("base_url"), "base_url", "base_url must be an http(s) URL"),
        violation(bad_url("terms_url"), "terms_url", "terms_url must be an http(s) URL"),
        violation(~of("allow_network").isin("true", "false"), "config.allow_network", "allow_network must be a boolean", "bool_type"),
        violation(~F.col("terms_accepted") & ~F.coalesce(of("terms_accepted") == "true", F.lit(False)), "terms_accepted",
                  "terms_accepted=True is required before enabling this source"),
        *[violation(bad, field, message) for field, (bad, message) in limits.items() if field in routed.columns],
        violation(F.col("adapter").isNull(), "config.adapter", unknown),
        violation(F.col("adapter").isNotNull() & network & F.col("base_url").isNull(), "base_url",
                  "base_url is required when allow_network=True"),
        violation(F.col("adapter").isNotNull() & ~network & has_fixture.isNull(), "config", fixture),
    ]
    return routed.withColumn("violations", F.array_compact(F.array(*checks)))


#: Hosts whose rules are read through others, one after another.
MOST_LENDERS = 3


def rules_in_force(hosts: DataFrame, lenders: DataFrame | None = None) -> DataFrame:
    """``(host, status, rules_of, rules_status)``: the host whose rules count for each of ``hosts(host, status)``.

    ``lenders(host, status, lender)``: a host that answered with that status uses the rules of its lender, and if that
    one answered with a status for which it has a lender itself, of that, up to ``MOST_LENDERS`` times. Of several lenders the
    first by name counts. A lender that was never asked has no status.
    """
    found = hosts.groupBy(F.lower("host").alias("host")).agg(F.min("status").alias("status"))
    out = found.withColumns({"rules_of": F.col("host"), "rules_status": F.col("status")})
    if lenders is None:
        return out
    lent = lenders.groupBy(F.lower("host").alias("_host"), F.col("status").alias("_status")).agg(F.min(F.lower("lender")).alias("_lender"))
    answered = found.select(F.col("host").alias("_of"), F.col("status").alias("_answer"))
    for _ in range(MOST_LENDERS):
        met = out.join(lent, (F.col("rules_of") == F.col("_host")) & (F.col("rules_status") == F.col("_status")), "left")
        met = met.join(answered, F.col("_lender") == F.col("_of"), "left")
        moved = F.col("_lender").isNotNull()
        out = met.select(
            "host", "status", F.coalesce("_lender", "rules_of").alias("rules_of"), F.when(moved, F.col("_answer")).otherwise(F.col("rules_status")).alias("rules_status")
        )
    return out


def apply_crawl_policy(urls: DataFrame, rules: DataFrame, hosts: DataFrame, lenders: DataFrame | None = None) -> DataFrame:
    """Verdict for ``urls(url)`` by ``rules(host, prefix, allow)`` and fetch results ``hosts(host, status)``.

    The longest matching prefix decides, allow wins ties, no match allows. Status 401 and 403 deny, other
    4xx allow, 5xx and no answer are unverifiable. With ``lenders`` a host may use the rules of another (``rules_in_force``);
    a lender's own rules could then not be read if it answered with 4xx, which is unverifiable. ``rules_of`` is the host
    whose rules counted, ``rule`` the prefix that decided, if one did.
    """
    host = F.lower(F.regexp_extract("url", HTTP, 2))
    path = F.regexp_extract("url", HTTP, 3)
    asked = urls.select("url", host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path")).distinct()
    asked = asked.join(rules_in_force(hosts, lenders), "host", "left").withColumn("rules_of", F.coalesce("rules_of", "host"))
    # Rules are met by equality with a beginning of the path, of a length that some rule of the host has: a host of
    # many rules and URLs is spread over its prefixes.
    of_host = rules.select(F.lower("host").alias("rules_of"), "prefix", "allow").groupBy("rules_of", "prefix").agg(F.max("allow").alias("allow"))
    lengths = of_host.groupBy("rules_of").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    begun = asked.join(lengths, "rules_of").select("url", "rules_of", "path", F.explode("_lengths").alias("_n"))
    begun = begun.filter(F.col("_n") <= F.length("path")).select("url", "rules_of", F.left("path", F.col("_n")).alias("prefix"))
    met = begun.join(of_host, ["rules_of", "prefix"])
    best = met.groupBy("url").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("best"))
    status, borrowed = F.col("rules_status"), F.col("rules_of") != F.col("host")
    allow = F.coalesce(F.col("best.allow"), F.lit(True))
    verdict = (
        F.when(borrowed & (status.isNull() | (status >= 400)), "unverifiable").when(status.isin(401, 403), "denied")
        .when(status.isNull() | (status >= 500), "unverifiable").when(status >= 400, "allowed").when(allow, "allowed").otherwise("denied")
    )
    rule = F.when(status < 400, F.col("best.prefix"))
    return asked.join(best, "url", "left").select("url", "host", verdict.alias("verdict"), "rules_of", rule.alias("rule"))
