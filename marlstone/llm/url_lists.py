"""Temporal list join for URLs.

Dated list entries become validity intervals; an as-of join evaluates each
capture against the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)"
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"

#: Captures of one domain, different in host and time, that one task sweeps; more are dealt to several.
PER_TASK = 1_000_000
#: Domains up to which a lookup is broadcast; beyond, it is joined by a shuffle.
BROADCAST_DOMAINS = 100_000


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and trailing dot, an IPv6 address with its brackets; null if the URL has none."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def changes(entries: DataFrame) -> DataFrame:
    """``category, domain, listed, since``: the changes of state of each entry, the first of them a listing."""
    e = (
        entries.select("category", F.lower("domain").alias("domain"), "listed", "since")
        .dropna()
        .groupBy("category", "domain", "since")
        .agg(F.max("listed").alias("listed"))
    )
    w = W.partitionBy("category", "domain").orderBy("since")
    return e.withColumn("before", F.lag("listed", 1, False).over(w)).where(F.col("listed") != F.col("before")).drop("before")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated entries.

    entries: ``category string, domain string, listed boolean, since timestamp``,
    each a change of state.  Returns ``category, domain, valid_from, valid_to``
    (end exclusive, null while it lasts); adjoining intervals are one.  Of changes
    of one entry at one time a listing wins; rows with a null are left out, for
    they name no entry or no time.  Other columns are ignored.
    """
    w = W.partitionBy("category", "domain").orderBy("since")
    return changes(entries).withColumn("valid_to", F.lead("since").over(w)).where("listed").select("category", "domain", F.col("since").alias("valid_from"), "valid_to")


def suffixes(name: Column) -> Column:
    """The host and each parent domain of two labels or more; a host of one label, or an address, is itself alone."""
    parts = F.split(name, r"\.")
    count = F.when(name.rlike(ADDRESS), 1).otherwise(F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _states(keyed: DataFrame, entries: DataFrame, per_task: int) -> DataFrame:
    """``host, at, category, valid_from`` of each entry that is active for a pair.

    keyed: ``host, at, domain``.  Pairs and the intervals of (domain, category) are
    united and swept in order of time, so a long history costs a row a change.  A
    domain of over ``per_task`` pairs is dealt to several sweeps, each with its intervals.
    """
    held = cut(intervals(entries))
    listed = held.groupBy("domain").agg(F.collect_set("category").alias("categories"))
    wanted = keyed.join(_few(listed), "domain")
    hot = wanted.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("shares")).where("shares > 1")
    hot = cut(hot)
    shares = F.coalesce("shares", F.lit(1))
    share = F.pmod(F.xxhash64("host", "at"), shares).cast("int")
    a = wanted.join(_few(hot), "domain", "left").select("domain", F.explode("categories").alias("category"), share.alias("share"), F.col("at").alias("time"), F.lit(1).alias("side"), F.struct("host", "at").alias("pair"))
    b = held.join(_few(hot), "domain", "left").select("domain", "category", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.col("valid_from").alias("time"), F.lit(0).alias("side"), F.struct("valid_from", "valid_to").alias("state"))
    swept = W.partitionBy("domain", "category", "share").orderBy("time", "side").rowsBetween(W.unboundedPreceding, 0)
    last = a.unionByName(b, allowMissingColumns=True).withColumn("state", F.last("state", ignorenulls=True).over(swept))
    active = F.col("state").isNotNull() & (F.col("state.valid_to").isNull() | (F.col("time") < F.col("state.valid_to")))
    return last.where((F.col("side") == 1) & active).select("pair.*", "category", "state.valid_from")


def _few(df: DataFrame) -> DataFrame:
    """With a broadcast hint if a count shows that there are few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_DOMAINS + 1).count() <= BROADCAST_DOMAINS else df


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", per_task: int = PER_TASK) -> DataFrame:
    """Every capture with the list entries active at its fetch time.

    Returns the id, ``host``, ``blocked boolean``, ``n_matches long`` (active
    entries on the host or a parent domain), ``categories`` (sorted, comma-joined,
    null without a match) and ``active_since`` (start of the oldest matching
    interval).  A null or hostless URL and a null fetch time match nothing; such
    rows stay.  Repeated rows give repeated results; an empty list blocks nothing.
    Other columns are ignored, whatever their names.

    Each different (host, time) is evaluated once, expanded by the labels of the
    host and by the categories of a listed domain, not by its history.
    """
    c = captures.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.col(time_col).alias("at"))
    pairs = c.select("host", "at").where("host IS NOT NULL AND at IS NOT NULL").distinct()
    keyed = pairs.select("host", "at", F.explode(suffixes(F.col("host"))).alias("domain"))
    hits = (
        _states(keyed, entries, per_task)
        .groupBy("host", "at")
        .agg(F.count(F.lit(1)).alias("n_matches"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min("valid_from").alias("active_since"))
    )
    out = c.join(hits, ["host", "at"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "host",
        F.col("n_matches").isNotNull().alias("blocked"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        "categories",
        "active_since",
    )
