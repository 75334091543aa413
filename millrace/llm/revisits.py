"""Not-modified revisit resolution for web captures.

A revisit (a capture whose server said "not modified") holds no body; it takes that of the latest earlier full response of the same
canonical URL, when their validators agree. An as-of join does that without gathering a URL's captures: captures of one instant are one
event, time is cut into slices (quantiles of all captures, each cut again evenly), and each (URL, slice) is reduced to its last full response. Those rows are carried
forward over the slices of a URL, by way of groups of slices where there are many, and within a slice the carried row and the slice's own
events decide. A URL that holds a third of all captures is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged

#: Headers that a 304 response may renew in a stored one (RFC 9111, section 3.2, by the usual list).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Cuts of all time, and slices that are carried over at once.
QUANTILES, FAN = 32, 1000
_TRACKING = r"(?i)^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme and www/m. host prefix dropped, host in lower case, no default port, fragment or tracking parameter, parameters sorted, no last slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _slice(ts: Column, cuts: list[int], each: int) -> Column:
    """The number of an instant's slice, ascending with time: the quantile it lies in, and one of `each` even parts of that."""
    lower = F.lit(cuts[0]).cast("long")
    upper, at = F.lit(cuts[1]).cast("long"), F.lit(0).cast("long")
    for i in range(1, len(cuts) - 1):
        lower = F.when(ts >= cuts[i], F.lit(cuts[i]).cast("long")).otherwise(lower)
        upper = F.when(ts >= cuts[i], F.lit(cuts[i + 1]).cast("long")).otherwise(upper)
        at = F.when(ts >= cuts[i], F.lit(i).cast("long")).otherwise(at)
    inside = F.floor((ts - lower).cast("double") / F.greatest(upper - lower, F.lit(1)).cast("double") * each).cast("long")
    return at * each + F.least(inside, F.lit(each - 1).cast("long"))


def _carried(last: DataFrame, slices: int, fan: int = FAN) -> DataFrame:
    """canonical, slice, carried: per row of last (canonical, slice, full; full may be null) the full of the latest earlier slice that has one.

    Over more than `fan` slices, groups of slices are carried first, and each slice looks within its group before that.
    """
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    if slices <= fan:
        return last.select("canonical", "slice", F.last("full", ignorenulls=True).over(before).alias("carried"))
    grouped = last.withColumn("group", F.floor(F.col("slice") / fan).cast("long"))
    upper = grouped.groupBy("canonical", F.col("group").alias("slice")).agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("slice"))).alias("full"))
    upper = _carried(upper, -(-slices // fan), fan).select("canonical", F.col("slice").alias("group"), F.col("carried").alias("above"))
    inside = Window.partitionBy("canonical", "group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.withColumn("inside", F.last("full", ignorenulls=True).over(inside))
    return own.join(upper, ["canonical", "group"]).select("canonical", "slice", F.coalesce("inside", "above").alias("carried"))


def resolve_revisits(captures: DataFrame, slice_rows: int = 5_000, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """record_id, canonical, ts, outcome, refers_to, etag, last_modified, payload_digest, headers: one row per capture.

    captures: record_id, url, ts (long), status (200 full, 304 revisit), etag, last_modified, payload_digest, headers map<string,string>.
    A revisit resolves to the full response of its canonical URL with the latest smaller ts (of equal ts, the greatest record_id, a null one
    last, and then the greatest etag, last_modified, payload_digest and headers). Validators agree where some validator is on both sides
    and no one differs; else the outcome is `mismatch`, and `no_validator` where none can be compared. No earlier response gives `missing`; full ones are `full`; a null status, url or ts, or another status, is `other`. A resolved
    row has the response's payload and headers, with permitted headers of the revisit over them; other rows keep their own. Repeated
    captures are resolved each; an empty table gives no rows; columns with other names are not read.
    """
    own = ["record_id", "ts", "status", "etag", "last_modified", "payload_digest", "headers"]
    rows = captures.select(canonical_url(F.col("url")).alias("canonical"), *own)
    usable = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(200, 304)
    usable = F.coalesce(usable, F.lit(False))
    timed = rows.where(usable)
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    times = timed.agg(F.percentile_approx("ts", shares, 10_000).alias("cuts"), F.count("*").alias("n")).first()
    cuts = sorted(set(times["cuts"] or [0]))
    cuts = cuts if len(cuts) > 1 else [cuts[0], cuts[0] + 1]
    each = max(1, -(-times["n"] // (slice_rows * (len(cuts) - 1))))
    is_full = F.col("status") == 200
    body = F.struct("ts", "record_id", "etag", "last_modified", "payload_digest", "headers")
    order = F.struct("record_id", "etag", "last_modified", "payload_digest", F.array_sort(F.map_entries("headers")).alias("h"))
    events = timed.groupBy("canonical", "ts").agg(F.max_by(F.when(is_full, body), F.when(is_full, order)).alias("full"), F.max((~is_full).cast("int")).alias("asked"))
    events = staged(events.withColumn("slice", _slice(F.col("ts"), cuts, each)), "events")
    last = events.groupBy("canonical", "slice").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("ts"))).alias("full"))
    carried = _carried(staged(last, "last"), each * (len(cuts) - 1))
    earlier = Window.partitionBy("canonical", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("inside", F.last("full", ignorenulls=True).over(earlier)).where("asked = 1").join(carried, ["canonical", "slice"], "left")
    sources = near.select("canonical", "ts", F.coalesce("inside", "carried").alias("source"))
    asked = timed.where(~is_full).join(sources, ["canonical", "ts"], "left")
    same = lambda c: F.col(c) == F.col(f"source.{c}")
    both = F.coalesce(same("etag"), same("last_modified")).isNotNull()
    differ = F.coalesce(~same("etag"), F.lit(False)) | F.coalesce(~same("last_modified"), F.lit(False))
    outcome = F.when(F.col("source").isNull(), "missing").when(~both, "no_validator").when(differ, "mismatch").otherwise("resolved")
    asked = asked.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    new = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k).isin(*permitted))
    renewed = F.transform(F.map_keys(new), lambda k: F.lower(k))
    old = F.map_filter(F.coalesce("source.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(renewed, F.lower(k)))
    merged = F.map_concat(old, new)
    done = asked.select(
        "record_id", "canonical", "ts", "outcome", F.when(ok, F.col("source.record_id")).alias("refers_to"), F.coalesce("etag", F.when(ok, F.col("source.etag"))).alias("etag"),
        F.coalesce("last_modified", F.when(ok, F.col("source.last_modified"))).alias("last_modified"), F.when(ok, F.col("source.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), F.when(ok, merged).otherwise(F.col("headers")).alias("headers"),
    )
    rest = rows.where(~usable | (F.coalesce(F.col("status"), F.lit(0)) == 200))
    kind = F.when(usable, "full").otherwise("other")
    plain = rest.select("record_id", "canonical", "ts", kind.alias("outcome"), F.lit(None).cast(dict(captures.dtypes)["record_id"]).alias("refers_to"), "etag", "last_modified", "payload_digest", "headers")
    return done.unionByName(plain)
