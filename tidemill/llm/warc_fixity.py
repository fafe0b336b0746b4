"""Merkle fixity audit of WARC records, with DataFrame functions.

A page becomes a WARC record; its position in the archive's order is its page_id. A leaf holds the digest of
the record at a position, a node the digest of the leaves or nodes of `fanout` positions or ranges of positions
in order, up to the root (and one for negative positions). Two replicas are compared from the roots: where digests agree nothing below is
looked at; only the children of differing nodes are joined on the next level down, until the differing leaves are found.

A level is one aggregation with at most `fanout` rows a group and is written to the shared folder, so a lost executor costs
one level. Defined results: a null url or html is empty; rows with the same page_id form one leaf from their
count and an order-free combination of their digests; rows with a null page_id are not in the archive's order and
take no part; negative page_ids are positions too; an empty replica lacks every position of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import read, saved

FANOUT = 32
#: What an encoded url writes for the characters that would break its line, the percent sign first.
BREAKS = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's WARC record, as text. A url that would break its header line stands in one of its own, percent-encoded."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    encoded = url
    for c, code in BREAKS:
        encoded = F.replace(encoded, F.lit(c), F.lit(code))
    odd = F.contains(url, F.lit("\r")) | F.contains(url, F.lit("\n"))
    target = F.when(odd, F.concat(F.lit("-Encoded: "), encoded)).otherwise(F.concat(F.lit(": "), url))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI"), target,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record, size) of pages (page_id, url, html)."""
    out = pages.where("page_id is not null").select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return out.withColumn("size", F.octet_length("record"))


def parsed(archive: DataFrame) -> DataFrame:
    """(page_id, url, html) read back from records."""
    r = F.col("record")
    head = F.substring_index(r, "\r\n\r\n", 1)
    size = F.regexp_extract(head, "\r\nContent-Length: ([0-9]+)", 1).cast("int")
    body = F.substring(F.encode(r, "utf-8"), F.octet_length(head) + 5, size).cast("string")
    decoded = F.regexp_extract(head, "WARC-Target-URI-Encoded: ([^\r]*)", 1)
    for c, code in reversed(BREAKS):
        decoded = F.replace(decoded, F.lit(code), F.lit(c))
    url = F.when(F.contains(head, F.lit("\r\nWARC-Target-URI-Encoded: ")), decoded).otherwise(F.regexp_extract(head, "WARC-Target-URI: ([^\r]*)", 1))
    return archive.select(F.regexp_extract(head, "<urn:page:(-?[0-9]+)>", 1).cast("long").alias("page_id"), url.alias("url"), body.alias("html"))


def tree(archive: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (at, digest, records, bytes), from the leaves to the roots at 0 and, of negative positions, -1."""
    h = F.sha2("record", 256)
    part = F.conv(F.substring(F.col("h"), 1, 12), 16, 10).cast("decimal(38,0)")
    leaf = archive.select("page_id", h.alias("h"), "size").groupBy(F.col("page_id").alias("at"))
    leaf = leaf.agg(F.count("*").alias("records"), F.sum("size").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"), F.sum(part).alias("all"))
    mixed = F.when(F.col("records") == 1, F.col("low")).otherwise(F.sha2(F.concat_ws("|", "records", "low", "high", "all"), 256))
    levels = [saved(leaf.select("at", mixed.alias("digest"), "records", "bytes"))]
    while not levels[-1].where("at not in (-1, 0)").isEmpty():
        levels.append(saved(_lifted(levels[-1], fanout)))
    return levels


def differing(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(at, expected, found, records_expected, records_found) of the leaves that differ; null where a replica has none."""
    while len(one) != len(two):
        short = one if len(one) < len(two) else two
        short.append(saved(_lifted(short[-1], fanout)))
    above = None
    for a, b in zip(reversed(one), reversed(two), strict=True):
        if above is not None:
            a, b = (x.join(above, F.floor(x["at"] / fanout) == above["up"], "left_semi") for x in (a, b))
        a, b = a.select("at", F.col("digest").alias("expected"), F.col("records").alias("records_expected")), b.select("at", F.col("digest").alias("found"), F.col("records").alias("records_found"))
        both = saved(a.join(b, "at", "full").where(~F.col("expected").eqNullSafe(F.col("found"))))
        above = both.select(F.col("at").alias("up"))
    return both


def _lifted(level: DataFrame, fanout: int) -> DataFrame:
    up = level.groupBy(F.floor(F.col("at") / fanout).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "digest")))
    digest = F.sha2(F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", x["at"].cast("string"), x["digest"]))), 256)
    return up.agg(digest.alias("digest"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


def audit(pages: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(page_id, kind, expected_sha256, found_sha256): every position at which the replica's archive differs."""
    out = differing(tree(records(pages), fanout), tree(records(replica), fanout), fanout)
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return out.select(F.col("at").alias("page_id"), kind.alias("kind"), F.col("expected").alias("expected_sha256"), F.col("found").alias("found_sha256"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with damage at known places: a byte more, a byte changed, a record lost, a record copied to a new place."""
    html = F.when(F.col("page_id") % 97 == 13, F.concat("html", F.lit(" "))).when(F.col("page_id") % 89 == 7, F.concat(F.lit("?"), F.substring("html", 2, 2**30))).otherwise(F.col("html"))
    kept = pages.where("page_id % 211 <> 5").select("page_id", "url", html.alias("html"))
    return kept.union(pages.where("page_id % 499 = 3").select((-F.col("page_id") - 1).alias("page_id"), "url", "html"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


SQL = r"""
WITH made AS (
  SELECT 1 AS replica, page_id, url, html FROM pages WHERE page_id IS NOT NULL
  UNION ALL
  SELECT 2, page_id, url, CASE WHEN page_id % 97 = 13 THEN html || ' ' WHEN page_id % 89 = 7 THEN '?' || substr(html, 2) ELSE html END FROM pages WHERE page_id % 211 <> 5
  UNION ALL
  SELECT 2, -page_id - 1, url, html FROM pages WHERE page_id % 499 = 3
), h AS (
  SELECT replica, page_id, sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS d
  FROM made
)
SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'extra' ELSE 'changed' END AS kind,
       a.d AS expected_sha256, b.d AS found_sha256
FROM (FROM h WHERE replica = 1) a FULL JOIN (FROM h WHERE replica = 2) b ON a.page_id = b.page_id
WHERE a.d IS DISTINCT FROM b.d
"""
