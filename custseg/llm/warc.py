"""Not-modified revisits resolved against the latest earlier full response.

An archive stores "304 not modified" captures as revisit records without a
body.  Each is joined to the latest full response of the same canonical URL
with an earlier time, its validators are checked, and the headers that a 304
may update replace the stored ones.

As-of join.  A URL may hold a third of all records, so its records are not put
in one task: the key is (URL, time slice of ``SLICE_SECONDS``).  Inside a slice
a window finds the last full response before each record.  Each (URL, slice)
also gives one summary row, its last full response; a window over the summaries
of a URL carries the last one forward, for the records whose own slice has none
before them.  The second window reads a row per slice instead of per record.

Canonical URL: scheme dropped, host in lower case without ``www.`` and default
port, fragment and ``utm_`` parameters dropped, no trailing slash.

Validators: the revisit's ETag, compared weakly (``W/`` and quotes ignored),
else its Last-Modified; ``status`` is ``resolved`` when it matches,
``unverified`` when the revisit carries neither or the response lacks the one
asked for, ``changed`` when it differs and ``missing`` when no earlier full
response exists.  Only resolved and unverified revisits get a target and
merged headers: names in ``UPDATABLE`` come from the revisit, all others from
the response.  Header names ignore case and come out in lower case; of two
spellings in one record the first in byte order counts.

Cases: a null URL or time never meets a response (``missing``) and takes no part in
the windows; a row whose kind is neither response nor revisit, or null, is no
revisit and has no row; of full responses with one time and id the greatest
(etag, last_modified, payload, headers) counts; of full
responses with the same time the greater record id counts; a response at the
revisit's own time is not earlier; repeated revisits are resolved each; null
headers are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 86_400
#: fixed values: header fields that a 304 response may update
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    u = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, "#.*$", "")
    host = F.regexp_extract(u, "^([^/?]*)", 1)
    rest = F.substr(u, F.length(host) + 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), "^www\\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(rest, "([?&])utm_[^&]*", "$1")      # empty the parameter, keep its mark
    rest = F.regexp_replace(rest, "&+", "&")
    rest = F.regexp_replace(F.regexp_replace(rest, "\\?&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+$", ""))


def _plain_etag(e: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(e, "^W/", ""), '"', "")


def lower_names(headers: Column) -> Column:
    """The headers with lower-case names (null: none)."""
    entries = F.coalesce(F.array_sort(F.map_entries(headers)), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(
        entries, lambda e: F.lower(e["key"]) == n)[0]["value"]))


def merged_headers(stored: Column, update: Column) -> Column:
    stored, update = lower_names(stored), lower_names(update)
    allowed = F.map_filter(update, lambda k, v: k.isin(*UPDATABLE))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per revisit of ``records`` (record_id, kind, url, time in seconds, etag,
    last_modified, headers, payload): record_id, canonical_url, status, target_id,
    headers, payload."""
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("_u"),
        F.col("time").cast("long").alias("_time"), (F.col("kind") == "response").alias("_full"),
        (F.col("kind") == "revisit").alias("_revisit"), "etag", "last_modified", "headers", "payload") \
        .filter("_full or _revisit").withColumn("_s", F.floor(F.col("_time") / slice_seconds))
    rows = rows.withColumn("_f", F.col("_full") & F.col("_u").isNotNull() & F.col("_time").isNotNull())
    place = F.when(F.col("_f"), F.struct(F.col("_time").alias("t"), F.col("record_id").alias("r")))
    known = F.col("_u").isNotNull() & F.col("_time").isNotNull()
    placed = rows.filter(known)
    slice_ = Window.partitionBy("_u", "_s")
    # responses of the same second are not earlier: frame by time, up to the second before
    earlier = slice_.orderBy("_time").rangeBetween(Window.unboundedPreceding, -1)
    light = placed.withColumn("_own", F.max(place).over(earlier))
    summary = placed.groupBy("_u", "_s").agg(F.max(place).alias("_last"))
    forward = Window.partitionBy("_u").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("_before", F.max("_last").over(forward)) \
        .select(F.col("_u").alias("_cu"), F.col("_s").alias("_cs"), "_before").filter("_before is not null")
    revisits = light.filter("_revisit").join(
        carried, (F.col("_u") == F.col("_cu")) & (F.col("_s") == F.col("_cs")), "left") \
        .withColumn("_at", F.coalesce("_own", "_before")) \
        .select("record_id", "_u", "etag", "last_modified", "headers", F.col("_at.t").alias("_at_t"),
                F.col("_at.r").alias("_at_r"))
    lost = rows.filter(~known & F.col("_revisit")).select(
        "record_id", "_u", "etag", "last_modified", "headers", F.lit(None).cast("long").alias("_at_t"),
        F.lit(None).cast("long").alias("_at_r"))
    revisits = revisits.unionByName(lost)
    targets = rows.filter("_f").groupBy("_u", "_time", "record_id").agg(
        F.max(F.struct("etag", "last_modified", "payload", F.array_sort(F.map_entries("headers")).alias("h"))).alias("_v")) \
        .select(F.col("_u").alias("_tu"), F.col("_time").alias("_tt"), F.col("record_id").alias("_tr"),
                F.col("_v.etag").alias("_te"), F.col("_v.last_modified").alias("_tl"),
                F.col("_v.payload").alias("_tp"), F.map_from_entries("_v.h").alias("_th"))
    got = revisits.join(targets, (F.col("_u") == F.col("_tu")) & (F.col("_at_t") == F.col("_tt"))
                        & (F.col("_at_r") == F.col("_tr")), "left")
    same = F.when(F.col("etag").isNotNull(), _plain_etag(F.col("etag")) == _plain_etag(F.col("_te"))) \
        .otherwise(F.col("last_modified") == F.col("_tl"))
    status = F.when(F.col("_tr").isNull(), "missing").when(same.isNull(), "unverified") \
        .when(same, "resolved").otherwise("changed")
    good = F.col("status").isin("resolved", "unverified")
    return got.withColumn("status", status).select(
        "record_id", F.col("_u").alias("canonical_url"), "status",
        F.when(good, F.col("_tr")).alias("target_id"),
        F.when(good, merged_headers(F.col("_th"), F.col("headers"))).alias("headers"),
        F.when(good, F.col("_tp")).alias("payload"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Records derived from a table of pages: every page gives a full response
    (captured one minute after the page before it) and a later revisit of its URL."""
    day = F.lit(86_400)
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")))
    time = F.col("page_id") * 60
    n = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    later = time + 1 + n % 30 * day
    def header(**kw):
        return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))])
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", time.alias("time"),
        F.concat(F.lit('"'), tag, F.lit('"')).alias("etag"), time.cast("string").alias("last_modified"),
        header(content_type=F.lit("text/html"), content_length=n, date=time, etag=tag).alias("headers"),
        F.col("html").alias("payload"))
    back = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url",
        later.alias("time"),
        F.when(n % 3 != 0, F.concat(F.lit('W/"'), tag, F.lit('"'))).alias("etag"),
        F.when(n % 2 == 0, time.cast("string")).alias("last_modified"),
        header(content_length=F.lit(0), date=later, vary=F.lit("accept")).alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    return full.unionByName(back)
