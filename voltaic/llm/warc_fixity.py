"""WARC fixity audit: Merkle trees over the records of each file, compared between replicas from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, without

#: Children of a tree node, and levels above the records: a file has FANOUT ** LEVELS record places at most.
FANOUT, LEVELS = 10, 3
PLACES = FANOUT**LEVELS
#: Files of pages without a page_id, and the number of the first of them: no page_id's file is as low.
UNNUMBERED, BELOW = 16, -(2**62)


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as bytes; null parts are empty."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame) -> DataFrame:
    """file, place, length, digest (SHA-256) of each page's record. A file holds PLACES page_ids in a row; any long may be one.

    Pages without one are dealt by url to files of their own, below all others.
    """
    dealt = F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(PLACES * UNNUMBERED))
    place = F.expr(f"pmod(page_id, {PLACES}L)")
    # Whole-number division rounds to zero.
    file = F.expr(f"page_id div {PLACES}L") - F.when((F.col("page_id") < 0) & (place > 0), 1).otherwise(0)
    file = F.when(F.col("page_id").isNull(), F.lit(BELOW) - F.floor(dealt / PLACES)).otherwise(file).cast("long")
    place = F.when(F.col("page_id").isNull(), F.pmod(dealt, F.lit(PLACES))).otherwise(place).cast("int")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select(file.alias("file"), place.alias("place"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))


def page_id(file: Column, place: Column) -> Column:
    """The page_id of a place; null in the files of pages without one."""
    # From the end of a negative file, as its start may lie below all longs.
    number = F.when(file < 0, (file + 1) * PLACES + (place - PLACES)).otherwise(file * PLACES + place)
    return F.when(file > BELOW, number).cast("long")


def leaves(records: DataFrame) -> DataFrame:
    """One leaf per place: its byte range in the file and its hash over length and digest.

    Records that share a place are one leaf, whatever their number and order: its hash is over their number, the sum of
    their lengths, and the sums of eight 32-bit lanes of the SHA-256 of each one's length and digest. Sums count equal
    records, none cancels another, they combine before the shuffle and take the same room for any number of records.
    """
    own = F.sha2(F.concat_ws(":", "length", "digest"), 256)
    lanes = [F.sum(F.conv(F.substring("own_", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    one = F.concat_ws(":", F.sum("length").cast("string"), F.min("digest"))
    many = F.concat_ws(":", F.count("*").cast("string"), F.sum("length").cast("string"), *lanes)
    by_place = records.withColumn("own_", own).groupBy("file", "place").agg(F.sum("length").alias("length"), F.sha2(F.when(F.count("*") == 1, one).otherwise(many), 256).alias("hash"))
    end = F.sum("length").over(Window.partitionBy("file").orderBy("place"))  # a file has PLACES rows at most
    return by_place.withColumn("end", end).select("file", F.col("place").alias("node"), "hash", (F.col("end") - F.col("length")).alias("start"), "end")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of nodes(file, node, hash, start, end) from the leaves up to one root per file; a node covers a range of bytes."""
    level = durable(leaves(records))
    out = [level]
    for _ in range(LEVELS):
        kids = F.array_sort(F.collect_list(F.struct("node", "hash")))  # FANOUT at most
        text = F.array_join(F.transform(kids, lambda k: F.concat_ws("=", k["node"].cast("string"), k["hash"])), ";")
        level = level.groupBy("file", F.floor(F.col("node") / FANOUT).cast("int").alias("parent")).agg(F.sha2(text, 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end"))
        level = durable(level.withColumnRenamed("parent", "node"))
        out.append(level)
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, place, kind, start, end, other_start, other_end of every place whose records differ between two replicas.

    kind: changed, missing (in right) or extra (in right). Roots are compared first; a level's nodes only where their
    parents differ. Nulls are hashed as empty; repeated records count; files on one side only differ throughout; equal
    or empty replicas give an empty result.
    """
    a, b = tree(records(without(left))), tree(records(without(right)))
    open_: DataFrame | None = None
    for i in range(LEVELS, -1, -1):
        x, y = (t[i].withColumn("parent", F.floor(F.col("node") / FANOUT).cast("int")) for t in (a, b))
        if open_ is not None:
            x, y = (t.join(open_, ["file", "parent"], "left_semi") for t in (x, y))
        x = x.select("file", "node", F.col("hash").alias("h"), F.col("start").alias("start"), F.col("end").alias("end"))
        y = y.select("file", "node", F.col("hash").alias("other"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
        bad = durable(x.join(y, ["file", "node"], "full").where(~F.col("h").eqNullSafe(F.col("other"))))
        open_ = bad.select("file", F.col("node").alias("parent"))
    kind = F.when(F.col("other").isNull(), "missing").when(F.col("h").isNull(), "extra").otherwise("changed")
    return bad.select("file", F.col("node").alias("place"), kind.alias("kind"), "start", "end", "other_start", "other_end")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted faults, for the query: where page_id modulo 101 is 7 a character is changed, at 8 the last one is cut off, at 9 the record is lost."""
    fault = F.pmod(F.col("page_id"), F.lit(101))
    half = F.floor(F.length("html") / 2).cast("int")
    swap = F.when(F.substring("html", half + 1, 1) == "#", "$").otherwise("#")
    changed = F.concat(F.substring("html", F.lit(1), half), swap, F.expr("substring(html, cast(floor(length(html) / 2) as int) + 2)"))
    html = F.when(fault == 7, changed).when(fault == 8, F.expr("left(html, greatest(length(html) - 1, 0))")).otherwise(F.col("html"))
    return pages.where(F.coalesce(fault != 9, F.lit(True))).withColumn("html", html)


def query(spark, pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    return audit(pages, damaged(pages)).withColumn("page_id", page_id(F.col("file"), F.col("place")))


ORACLE = f"""
WITH own AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, ((page_id % 101) + 101) % 101 AS fault, cast(floor(length(coalesce(html, '')) / 2) AS BIGINT) AS half FROM pages
), both_ AS (
  SELECT 0 AS replica, page_id, url, html FROM own
  UNION ALL
  SELECT 1, page_id, url, CASE
    WHEN fault = 7 THEN substring(html, 1, half) || CASE WHEN substring(html, half + 1, 1) = '#' THEN '$' ELSE '#' END || substring(html, half + 2)
    WHEN fault = 8 THEN substring(html, 1, greatest(length(html) - 1, 0)) ELSE html END
  FROM own WHERE fault <> 9
), record AS (
  SELECT replica, page_id, 'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || url || '\r\nContent-Length: ' || octet_length(encode(html)) || '\r\n\r\n' || html || '\r\n\r\n' AS bytes FROM both_
), placed AS (
  SELECT replica, page_id, cast(floor(page_id / {PLACES}.0) AS BIGINT) AS file, sha256(bytes) AS digest, octet_length(encode(bytes)) AS length,
    sum(octet_length(encode(bytes))) OVER (PARTITION BY replica, cast(floor(page_id / {PLACES}.0) AS BIGINT) ORDER BY page_id) AS end_
  FROM record
), a AS (SELECT * FROM placed WHERE replica = 0), b AS (SELECT * FROM placed WHERE replica = 1)
SELECT coalesce(a.file, b.file) AS file, cast(coalesce(a.page_id, b.page_id) - coalesce(a.file, b.file) * {PLACES} AS INTEGER) AS place,
  CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' ELSE 'changed' END AS kind,
  cast(a.end_ - a.length AS BIGINT) AS start, cast(a.end_ AS BIGINT) AS "end", cast(b.end_ - b.length AS BIGINT) AS other_start, cast(b.end_ AS BIGINT) AS other_end,
  coalesce(a.page_id, b.page_id) AS page_id
FROM a FULL JOIN b ON a.page_id = b.page_id
WHERE a.digest IS DISTINCT FROM b.digest
""".replace("\r\n", "' || chr(13) || chr(10) || '")
