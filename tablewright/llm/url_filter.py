"""URL lists that change over time: each capture is judged by the entries active when it was fetched.

Dated list entries (pattern, kind, active, at) become validity intervals: an entry that switches a
pattern on holds until the next entry of the same pattern and kind. A pattern is a host, which covers
its subdomains, or a host with a path, which covers everything below that path. A capture is joined
as of its fetch time to the intervals of all its host suffixes and path prefixes; the longest pattern
wins, and of equal patterns ``block`` wins over ``allow``.

Defined cases: captures without a url or time get the verdict ``none``, as do those that no interval
covers; entries without pattern, kind or time are ignored; of entries at the same moment an active one
wins; an interval starts at its moment and ends just before the next; repeated captures each keep their row.
Extra columns are kept; clashing ``verdict`` and ``pattern`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.columns import column

#: Length of the time buckets that split hot patterns and bound what is compared per capture.
BUCKET_SECONDS = 30 * 86400


def normalized(url: Column) -> Column:
    """``host/path`` of a url: no scheme, user, port, query or fragment; host in lower case."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^.*@|:[0-9]*$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(.*)$", 1), r"/+$", "")
    return F.concat(F.regexp_replace(host, r"\.+$", ""), path)


def keys(place: Column) -> Column:
    """All patterns that cover a normalised url: host suffixes, then the host with each path prefix."""
    host = F.split(F.substring_index(place, "/", 1), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(host)), lambda i: F.array_join(F.slice(host, i, F.size(host)), ".")
    )
    parts = F.split(place, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(suffixes, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (pattern, kind, since, until) in epoch seconds; ``until`` is null for open ends."""
    dated = (
        entries.filter("pattern is not null and kind is not null and at is not null")
        .groupBy(normalized(F.col("pattern")).alias("pattern"), "kind", F.col("at").alias("since"))
        .agg(F.max(F.coalesce("active", F.lit(False))).alias("active"))
    )
    order = Window.partitionBy("pattern", "kind").orderBy("since")
    return dated.withColumn("until", F.lead("since").over(order)).filter("active").drop("active")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """Adds ``verdict`` (block, allow or none) and the deciding ``pattern`` to every capture.

    Equal (url, time) pairs are judged once. Intervals are cut into time buckets within the range of
    the captures, so that the join has an equality on pattern and bucket: a hot host is spread over
    the buckets, and each capture meets only the few intervals of one pattern in one bucket.
    """
    bucket = F.floor(F.col("moment") / BUCKET_SECONDS)
    asked = captures.select(column(url).alias("asked"), column(at).alias("moment")).filter(
        "asked is not null and moment is not null"
    ).distinct()
    span = asked.agg(F.min("moment").alias("low"), F.max("moment").alias("high"))
    valid = intervals(entries).crossJoin(F.broadcast(span)).filter("since <= high and (until is null or until > low)")
    first = F.floor(F.greatest("since", "low") / BUCKET_SECONDS)
    last = F.floor(F.least(F.coalesce(F.col("until") - 1, F.col("high")), F.col("high")) / BUCKET_SECONDS)
    cut = valid.select("pattern", "kind", "since", "until", F.explode(F.sequence(first, last)).alias("bucket"))
    probes = asked.select("asked", "moment", bucket.alias("bucket"), F.explode(keys(normalized(F.col("asked")))).alias("pattern"))
    hits = probes.join(cut, ["pattern", "bucket"]).filter("since <= moment and (until is null or moment < until)")
    best = hits.groupBy("asked", "moment").agg(
        F.max(F.struct(F.length("pattern").alias("size"), (F.col("kind") == "block").alias("block"), "pattern", "kind")).alias("best")
    )
    judged = best.select("asked", "moment", F.col("best.kind").alias("found"), F.col("best.pattern").alias("by"))
    # All columns travel in one, so that their names cannot clash with those used here.
    kept = [column(c) for c in captures.columns if c not in ("verdict", "pattern")]
    whole = captures.select(F.struct(*kept).alias("all"), column(url).alias("asked"), column(at).alias("moment"))
    joined = whole.join(judged, ["asked", "moment"], "left")
    return joined.select("all.*", F.coalesce("found", F.lit("none")).alias("verdict"), F.col("by").alias("pattern"))
