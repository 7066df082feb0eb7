"""Revisit records that say "not modified": resolved to the latest earlier full response of the canonical URL.

An as-of join without a task for each URL: all records are dealt by ranges of (URL, time, id), so even one URL's records
fall into many partitions; each finds the latest response within its own partition, and where there is none, in the last
earlier partition that has one for the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import checkpoint

#: Header fields that a 304 response may renew in the stored response; all others stay as stored.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that name no page.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port and leading www; path without a last slash; other parameters sorted.

    The scheme and the fragment go. Null for null and for what has no scheme and host.
    """
    bare = F.regexp_replace(F.btrim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1)), r":(80|443)$", ""), r"^www\d*\.", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    parameters = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.btrim(tag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit of records: record_id, url_key, resolved_id, outcome and headers.

    records: record_id long, url string, ts long, kind string (`response`: a full one; `revisit`), etag, last_modified
    strings, headers map of lower-case names. Other kinds and columns are ignored. Earlier means a smaller (ts, record_id).
    outcome: `resolved` if the etags agree (weakly), or without one in the revisit, the last_modified; `mismatch` if they
    don't; `unvalidated` if the revisit has neither; `no_response` if there is none earlier, or ts or the URL is null.
    headers are merged only where resolved (stored fields, renewed by the permitted ones of the revisit), else the
    revisit's own. resolved_id is given for resolved and unvalidated ones. Repeated revisits are each answered.
    """
    slim = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified", "headers")
    placed = slim.where("url_key is not null and ts is not null")
    lost = slim.where("kind = 'revisit' and (url_key is null or ts is null)")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(placed.repartitionByRange(n, "url_key", "ts", "record_id").withColumn("part", F.spark_partition_id()))
    stored = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    before = Window.partitionBy("url_key", "part").orderBy("ts", "record_id", F.col("kind") == "revisit").rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("near", F.last(stored, ignorenulls=True).over(before)).where("kind = 'revisit'")
    tails = ranged.groupBy("url_key", "part").agg(F.max_by(stored, F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("tail"))
    # A row for each partition that a URL reaches: no more than there are partitions.
    parts = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("url_key", "part", F.last("tail", ignorenulls=True).over(parts).alias("far")).where("far is not null")
    found = near.join(carried, ["url_key", "part"], "left").select("record_id", "url_key", "etag", "last_modified", "headers", F.coalesce("near", "far").alias("full"))
    none = lost.select("record_id", "url_key", "etag", "last_modified", "headers", F.lit(None).cast(found.schema["full"].dataType).alias("full"))
    agrees = F.when(F.col("etag").isNotNull(), _weak(F.col("etag")) == _weak(F.col("full.etag"))).otherwise(F.col("last_modified") == F.col("full.last_modified"))
    outcome = F.when(F.col("full").isNull(), "no_response").when(F.col("etag").isNull() & F.col("last_modified").isNull(), "unvalidated").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    judged = found.unionByName(none).withColumn("outcome", outcome)
    renewed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter(F.coalesce("full.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(renewed), k), F.lit(False)))
    return judged.select("record_id", "url_key", F.when(F.col("outcome").isin("resolved", "unvalidated"), F.col("full.record_id")).alias("resolved_id"), "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(kept, renewed)).otherwise(F.col("headers")).alias("headers"))


def header_lines(headers: Column) -> Column:
    """Headers as lines sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def records_of_pages(pages: DataFrame, delay: int = 2000) -> DataFrame:
    """Records made from (page_id, url, html): each page's full response, and delay page numbers later a revisit of its URL.

    The revisit names the URL in another form and the etag of its page, so it fails where another page of the canonical URL
    was stored in between.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    text = lambda c: F.col(c).cast("string")
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), text("page_id"), F.lit("etag"), tag, F.lit("server"), F.lit("a")).alias("headers"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#revisit")).alias("url"), (F.col("page_id") * 2 + 2 * delay + 1).alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") + delay).cast("string"), F.lit("expires"), (F.col("page_id") + 2 * delay).cast("string")).alias("headers"))
    return full.unionByName(revisit)
