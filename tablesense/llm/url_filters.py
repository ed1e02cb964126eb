"""URL filters as a temporal list join.

Filter lists change: an entry is added on one day and removed on another. The dated log becomes validity
intervals, and every capture is evaluated against the entries that were active when it was fetched. An entry
names a domain (with all its subdomains), a host, or a path prefix of a host; a capture looks up all of these
by equality, so no pattern is compared with every address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.common import stored

BROADCAST_ENTRIES = 500_000


def intervals(entries: DataFrame) -> DataFrame:
    """(list, allows, kind, value, valid_from, valid_to) from (list, allows, kind, value, at, action).

    ``action`` is add or remove. An add holds until the next row of the same list, kind and value. At one time an
    add beats a remove, and repeated rows count once. Removes of what is not listed do nothing; the last add has
    no end (null). Rows with a null value, time or action are left out. The host in a value is lowered.
    """
    entries = entries.withColumn("value", F.concat(F.lower(F.substring_index("value", "/", 1)), F.regexp_extract("value", "(?s)(/.*)?$", 0)))
    rows = entries.where("value is not null and at is not null and action in ('add', 'remove')")
    rows = rows.groupBy("list", "allows", "kind", "value", "at").agg(F.max(F.col("action") == "add").alias("added"))
    own = Window.partitionBy("list", "allows", "kind", "value").orderBy("at")
    rows = rows.withColumn("valid_to", F.lead("at").over(own)).where("added")
    return rows.select("list", "allows", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def host(url: str = "url"):
    """Lower-case host without user, port and final dot; empty where the address has none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def lookups(captures: DataFrame) -> DataFrame:
    """(capture, at, kind, value): everything of an address that an entry may name."""
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    rows = captures.select("capture", "at", host().alias("host"), F.filter(F.split(path, "/"), lambda s: s != "").alias("steps"))
    rows = rows.where("host <> ''").withColumn("labels", F.split("host", r"\."))
    size = F.size("labels")
    domains = F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice("labels", i, size), "."))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size("steps")), lambda i: F.concat("host", F.lit("/"), F.array_join(F.slice("steps", F.lit(1), i), "/"))
    )

    def named(kind: str, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    every = F.concat(named("domain", domains), named("host", F.array("host")), named("prefix", prefixes))
    return rows.select("capture", "at", F.explode(every).alias("x")).select("capture", "at", "x.kind", "x.value")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All columns of ``captures`` (capture, url, at, anything else) with host, n_active, active_list, active_since, blocked.

    ``capture`` tells captures apart. ``n_active`` counts entries that name the address and were valid at ``at``;
    ``active_list`` is the first of their lists by name and ``active_since`` when the latest of them began. A
    capture is blocked if an entry is active and none of a list that allows. Captures without a host or a time
    match nothing. Columns of ``captures`` with the names of results are replaced.
    """
    valid = stored(intervals(entries), "list-intervals")
    if valid.count() <= BROADCAST_ENTRIES:
        valid = F.broadcast(valid)
    asked = lookups(captures)
    active = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    hits = asked.join(valid, ["kind", "value"]).where(active).groupBy("capture").agg(
        F.count("*").alias("n_active"), F.min("list").alias("active_list"), F.max("valid_from").alias("active_since"), F.max("allows").alias("allowed")
    )
    rows = captures.drop("n_active", "active_list", "active_since", "allowed").join(hits, "capture", "left").withColumn("host", host()).withColumn("n_active", F.coalesce("n_active", F.lit(0)))
    return rows.withColumn("blocked", (F.col("n_active") > 0) & ~F.coalesce("allowed", F.lit(False))).drop("allowed")
