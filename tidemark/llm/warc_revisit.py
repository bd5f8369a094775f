"""Resolving not-modified revisit records to the latest earlier full response of the same canonical URL.

An as-of join without a range join and without one task for a hot URL: time is cut into slices that hold equally many
captures (bursts get more slices; where the cuts lie never changes a result); inside (URL, slice) a
running window finds the latest response before each revisit; where a slice has none yet, the last response of the
slices before it is carried in, from a table with one row for each URL and slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import canonical_url

#: Headers that a not-modified answer may bring up to date; all others stay as the full response had them.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def _lower_keys(headers: Column) -> Column:
    """Names in lower case; of names that differ by case alone, the first by code point counts."""
    sorted_ = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("own"), e["value"].alias("value"))))
    first = F.filter(sorted_, lambda e, i: (i == 0) | (F.get(sorted_, i - 1)["key"] != e["key"]))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, '^W/', "")


def resolve_revisits(captures: DataFrame, slices: int = 64) -> DataFrame:
    """For each revisit: capture_id, canonical_url, response_id, validated, payload_digest, headers.

    captures: capture_id long, url string, ts timestamp or number, kind ('response' or 'revisit'), etag, last_modified,
    payload_digest string, headers map<string,string> (of names that differ by case alone, the first by code point counts).
    Other columns are not read.
    The response is the latest with a strictly earlier time (ties: larger capture_id). validated: 'etag' if both have one
    and they match (weakly), else 'last-modified' likewise, else 'digest'; 'mismatch' if a validator that both have
    differs, 'unchecked' if they share none, 'missing' without an earlier response. response_id, payload_digest and
    headers are null unless validated. headers: those of the response under lower-case names, with the revisit's PERMITTED ones
    in place of the old. Rows with a null url or time match nothing; repeated rows each give a row; an empty table
    gives none.
    """
    own = captures.select("capture_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts"), "kind", "etag", "last_modified", "payload_digest", "headers")
    at = F.col("ts").cast("double")
    cuts = own.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 10_000).alias("cuts")).first()["cuts"] if slices > 1 else []
    slice_ = reduce(lambda a, c: a + (at >= c).cast("int"), sorted(set(cuts or [])), F.lit(0))
    full = F.struct(F.col("capture_id").alias("id"), "etag", "last_modified", F.col("payload_digest").alias("digest"), "headers")
    rows = own.withColumns({"slice": slice_, "full": F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), full), "later": F.when(F.col("kind") == "response", 1).otherwise(0)})
    rows = rows.where(F.col("kind").isin("response", "revisit"))
    # responses follow revisits of the same time, so these do not see them; a null time or URL is kept apart
    known = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    inside = Window.partitionBy("canonical_url", "slice").orderBy("ts", "later", "capture_id").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.where(known).withColumn("here", F.last("full", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    last = rows.where(known & (F.col("kind") == "response")).groupBy("canonical_url", "slice").agg(F.max_by("full", F.struct("ts", "capture_id")).alias("full"))
    # a row for each URL and slice that has anything: few for any URL
    steps = rows.where(known).select("canonical_url", "slice").distinct().join(last, ["canonical_url", "slice"], "left")
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.last("full", ignorenulls=True).over(before)).select("canonical_url", "slice", "carried")
    found = near.join(carried, ["canonical_url", "slice"], "left").withColumn("r", F.coalesce("here", "carried"))
    lost = rows.where(~known & (F.col("kind") == "revisit")).withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    keep = ["capture_id", "canonical_url", "etag", "last_modified", "payload_digest", "headers", "r"]
    found = found.select(keep).unionByName(lost.select(keep))
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    r = F.col("r")
    validated = (
        F.when(r.isNull(), "missing")
        .when(both(r["etag"], F.col("etag")), F.when(_tag(r["etag"]) == _tag(F.col("etag")), "etag").otherwise("mismatch"))
        .when(both(r["last_modified"], F.col("last_modified")), F.when(r["last_modified"] == F.col("last_modified"), "last-modified").otherwise("mismatch"))
        .when(both(r["digest"], F.col("payload_digest")), F.when(r["digest"] == F.col("payload_digest"), "digest").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    none = F.create_map().cast("map<string,string>")
    old, new = _lower_keys(F.coalesce(r["headers"], none)), F.map_filter(_lower_keys(F.coalesce("headers", none)), lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    ok = F.col("validated").isin("etag", "last-modified", "digest")
    return found.withColumn("validated", validated).select(
        "capture_id", "canonical_url", F.when(ok, r["id"]).alias("response_id"), "validated", F.when(ok, r["digest"]).alias("payload_digest"), F.when(ok, merged).alias("headers")
    )
