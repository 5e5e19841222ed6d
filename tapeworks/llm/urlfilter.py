"""Filtering captures by URL lists that change over time.

A list is a log of dated entries: on a day, a host, a domain (with all hosts below it) or a path prefix of a host is added
or removed. Each key's entries become validity intervals, and each capture is held against the entries that were active when
it was fetched.

Captures are reduced to places first: a host, the path as far down as the list goes for that host (nothing for hosts of which it
names no path), and a day. The keys of places and their days, each pair once, meet the intervals in an as-of join: both are put
in order of day within a key, and each asked day takes the interval that began last. A key's group holds a row for each
of its entries and each day on which it is asked, however many captures or hosts lie below it. Intervals and places are
written to the shared folder, as several joins read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import as_table


def url_host(url):
    """Lower-case host without port, user and closing full stop, an IPv6 address with its brackets; null if the URL has none."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(host, r"\.$", "")), F.lit(""))


def url_path(url):
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """entries (key, day, action add/remove, category) -> (key, category, since, until): when each key is listed, until exclusive.

    Of several entries of a key on one day the removal wins, then the first category by code point. until is null while
    listed. Entries with a null key or day are not entries.
    """
    e = entries.where(F.col("key").isNotNull() & F.col("day").isNotNull()).groupBy("key", "day").agg(F.max("action").alias("action"), F.min("category").alias("category"))
    e = e.withColumn("until", F.lead("day").over(W.partitionBy("key").orderBy("day")))
    return e.where("action = 'add'").select("key", "category", F.col("day").alias("since"), "until")


def host_keys(host):
    """The keys that may list a host: `=host`, and `.domain` for it and each domain above it of two labels or more."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.concat(F.array(F.concat(F.lit("="), host)), domains)


def segments(key, depth):
    """A path key cut after `depth` segments."""
    return F.call_function("substring_index", key, F.lit("/"), depth + 2)


def path_key(host, path, depth):
    """`/host/a/b`: the host and its path's first `depth` segments, or all it has; a path ends at its first empty segment."""
    whole = F.regexp_replace(F.substring_index(path, "//", 1), "/$", "")  # a repeated group would overflow the stack on long paths
    return segments(F.concat(F.lit("/"), host, whole), depth)


def listed_depths(listed: DataFrame) -> DataFrame:
    """(host, depths): the numbers of segments of the paths that the list names, for each host with any."""
    parts = F.split("key", "/")
    paths = listed.where(F.col("key").startswith("/")).select(parts[1].alias("host"), (F.size(parts) - 2).alias("depth")).where("depth > 0")
    return paths.groupBy("host").agg(F.sort_array(F.collect_set("depth")).alias("depths"))


def active(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """The as-of join: asked (key, day, each pair once) -> those whose key is listed on that day, with the interval's category and since."""
    begun = listed.select("key", F.col("since").alias("day"), F.lit(0).alias("asks"), F.struct("category", "since", "until").alias("entry"))
    asks = asked.join(listed.select("key"), "key", "left_semi").select("key", "day", F.lit(1).alias("asks"))
    latest = F.last("entry", ignorenulls=True).over(W.partitionBy("key").orderBy("day", "asks").rowsBetween(W.unboundedPreceding, 0))
    both = begun.unionByName(asks, allowMissingColumns=True).select("key", "day", "asks", latest.alias("entry")).where("asks = 1 and entry is not null")
    return both.where("entry.until is null or day < entry.until").select("key", "day", "entry.category", "entry.since")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """captures with host, blocked, category, matched (the key) and listed_since of the entry that was active on the capture's day.

    Of several active entries the narrowest counts: the longest path, then host, then the longest domain. Captures without a host or a
    day match nothing and stay, blocked false. Repeated rows each stay. Columns may have any name; those named as the new ones are
    replaced. Empty tables give no rows, an empty list blocks nothing. A long path costs one key for each depth at which
    the list names paths of its host.
    """
    new = ("host", "blocked", "category", "matched", "listed_since")
    inner = {f"c{i}": name for i, name in enumerate(captures.columns)}
    place = ["host", "prefix", "day"]
    url, day = (F.col(f"c{captures.columns.index(c)}") for c in (url_col, day_col))
    listed = as_table(intervals(entries), "intervals")

    rows = captures.toDF(*inner).withColumns({"host": url_host(url), "day": day}).join(listed_depths(listed), "host", "left")
    rows = rows.withColumn("prefix", F.coalesce(path_key(F.col("host"), url_path(url), F.array_max("depths")), F.lit("")))
    places = as_table(rows.where("host is not null and day is not null").select(*place, "depths").distinct(), "places")

    of_host = places.select("host", "day").distinct().withColumn("key", F.explode(host_keys(F.col("host"))))
    deep = F.size(F.split("prefix", "/")) - 2
    of_path = places.where("depths is not null").withColumn("depth", F.explode(F.filter("depths", lambda n: n <= deep))).withColumn("key", segments(F.col("prefix"), F.col("depth")))
    found = active(of_host.select("key", "day").union(of_path.select("key", "day")).distinct(), listed)
    entry = F.struct("key", "category", "since")
    kind = F.struct(F.col("key").startswith("=").alias("exact"), F.length("key").alias("n"))
    hosts = of_host.join(found, ["key", "day"]).groupBy("host", "day").agg(F.max_by(entry, kind).alias("by_host"))
    paths = of_path.join(found, ["key", "day"]).groupBy(*place).agg(F.max_by(entry, "depth").alias("by_path"))
    best = places.join(hosts, ["host", "day"], "left").join(paths, place, "left").select(*place, F.coalesce("by_path", "by_host").alias("m")).where("m is not null")

    out = rows.join(best, place, "left")
    own = [F.col(c).alias(name) for c, name in inner.items() if name not in new]
    return out.select(*own, "host", F.col("m").isNotNull().alias("blocked"), F.col("m.category").alias("category"), F.col("m.key").alias("matched"), F.col("m.since").alias("listed_since"))
