"""Merkle fixity audit of WARC replicas.

Every record has an address, (archive, offset).  Records are hashed, ordered
ranges of offsets are hashed over their records, and ranges are hashed in groups
of FANOUT up to one root per archive.  Two replicas are compared root by root;
below a root that differs only the branches that differ are followed, down to
the records themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import prepare, write_shared

ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 1 << 16
FANOUT = 16


def levels() -> int:
    """Levels of the tree above the ranges, the root's included."""
    nodes, n = ARCHIVE_BYTES // RANGE_BYTES, 0
    while nodes > 1:
        nodes, n = -(-nodes // FANOUT), n + 1
    return n


def record_bytes(url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as binary: header, body, two line ends; a null is empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit("")).cast("binary")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(header.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(key, digest, length) of each page's record; the bodies go no further than their scan."""
    data = record_bytes(F.col(url_col), F.col(body_col))
    return pages.select(
        F.col(key_col).alias("key"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("length")
    )


def addressed(own: DataFrame) -> DataFrame:
    """(key, digest, length, archive, offset): records laid out one after the other, by key and digest.

    Records that are equal in all columns are counted first and get their
    addresses by multiplication, so no number of copies meets in one task; the
    ranges of keys are summed up in two steps.  Null keys come first.
    """
    prepare(own.sparkSession)
    counted = own.groupBy("key", "digest", "length").agg(F.count(F.lit(1)).alias("copies"))
    placed = counted.repartitionByRange("key", "digest").sortWithinPartitions(F.asc_nulls_first("key"), "digest")
    number = F.monotonically_increasing_id()
    placed = write_shared(placed.withColumn("number", number).withColumn("part", F.shiftright("number", 33)), "records")
    size = F.col("length") * F.col("copies")
    # one row per partition: bounded by the partitions, not by the data
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum(size).alias("bytes"))
    parts = parts.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum(size).over(within), F.lit(0)))
    placed = placed.join(F.broadcast(parts), "part").withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    )
    place = F.col("start") + F.col("inner") + F.col("copy") * F.col("length")
    return placed.select(
        "key",
        "digest",
        "length",
        F.floor(place / ARCHIVE_BYTES).cast("long").alias("archive"),
        (place % ARCHIVE_BYTES).alias("offset"),
    )


def tree(own: DataFrame) -> DataFrame:
    """(archive, level, node, digest): level 0 are the ranges, the highest level has one root per archive.

    A range holds at most RANGE_BYTES / (bytes of a record's header) records and
    a node FANOUT children, so no group grows with the data.
    """

    def hashed(rows: DataFrame, order: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct(order, "digest")))
        text = F.transform(parts, lambda x: F.concat_ws(":", x[order], x["digest"]))
        return rows.groupBy("archive", "node").agg(F.sha2(F.array_join(text, "\n"), 256).alias("digest"))

    node = F.floor(F.col("offset") / RANGE_BYTES).cast("long")
    level = hashed(own.withColumn("node", node), "offset")
    out = level.withColumn("level", F.lit(0))
    for n in range(1, levels() + 1):
        level = level.select("archive", F.col("node").alias("child"), "digest")
        level = hashed(level.withColumn("node", F.floor(F.col("child") / FANOUT).cast("long")), "child")
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return write_shared(out, "merkle", partition_by="level")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(archive, offset, key, length, status) of every record in which the replicas differ.

    Both are (key, digest, length, archive, offset) tables.  ``status`` is
    'altered' (another digest at the address), 'missing' (only in the primary)
    or 'extra' (only in the replica; key and length are the replica's).  Equal
    replicas and empty tables give no row; a null key is a key like others.
    """
    a, b = tree(primary), tree(replica)
    wrong = None
    for n in range(levels(), -1, -1):
        sides = [t.where(F.col("level") == n).select("archive", "node", F.col("digest").alias(d)) for t, d in ((a, "da"), (b, "db"))]
        if wrong is not None:
            parent = [F.col("archive"), F.floor(F.col("node") / FANOUT).cast("long")]
            inside = wrong.select(F.col("archive").alias("wa"), F.col("node").alias("wn"))
            sides = [s.join(inside, (parent[0] == F.col("wa")) & (parent[1] == F.col("wn")), "left_semi") for s in sides]
        both = sides[0].join(sides[1], ["archive", "node"], "full")
        wrong = write_shared(both.where(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "node"), "mismatch")
        if wrong.isEmpty():
            break
    node = F.floor(F.col("offset") / RANGE_BYTES).cast("long")
    found = [
        t.withColumn("node", node)
        .join(wrong, ["archive", "node"], "left_semi")
        .select("archive", "offset", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "digest", "length")))
        for t, s in ((primary, "p"), (replica, "r"))
    ]
    both = found[0].join(found[1], ["archive", "offset"], "full")
    lost, new = F.col("digest_r").isNull(), F.col("digest_p").isNull()
    return both.where(~F.col("digest_p").eqNullSafe(F.col("digest_r"))).select(
        "archive",
        "offset",
        F.when(new, F.col("key_r")).otherwise(F.col("key_p")).alias("key"),
        F.when(new, F.col("length_r")).otherwise(F.col("length_p")).alias("length"),
        F.when(lost, "missing").when(new, "extra").otherwise("altered").alias("status"),
    )


# First two digits of a url's SHA-256 whose records the query's replica damages.
ROTTEN, LOST = ("07", "47", "87", "c7"), ("0b", "4b", "8b", "cb")


def op3_query(pages: DataFrame) -> DataFrame:
    """Audit of the archive of all pages against a replica with planted damage.

    The replica lays the records out alike; chosen by the SHA-256 of their urls,
    some records have another first character in their body and some are lost.
    """
    lot = F.sha2(F.coalesce("url", F.lit("")).cast("binary"), 256).substr(1, 2)
    body = F.coalesce("html", F.lit(""))
    bad = F.when(lot.isin(*ROTTEN), F.concat(F.lit("#"), F.substr(body, F.lit(2)))).otherwise(body)
    data = record_bytes(F.col("url"), F.col("html"))
    other = F.when(lot.isin(*LOST), F.lit("")).otherwise(F.sha2(record_bytes(F.col("url"), bad), 256))
    own = pages.select(
        F.struct(F.col("page_id").alias("id"), other.alias("replica")).alias("key"),
        F.sha2(data, 256).alias("digest"),
        F.octet_length(data).cast("long").alias("length"),
    )
    placed = write_shared(addressed(own), "addressed")
    primary = placed.withColumn("key", F.col("key.id"))
    replica = placed.where("key.replica <> ''").withColumns({"digest": F.col("key.replica"), "key": F.col("key.id")})
    return audit(primary, replica).withColumnRenamed("key", "page_id")


def _record_sql(body: str) -> str:
    line = "chr(13) || chr(10)"
    return (
        f"'WARC/1.1' || {line} || 'WARC-Type: resource' || {line} || 'WARC-Target-URI: ' || u || {line}"
        f" || 'Content-Type: text/html' || {line} || 'Content-Length: ' || strlen({body}) || {line} || {line}"
        f" || {body} || {line} || {line}"
    )


OP3_SQL = f"""
WITH pages_ AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS body,
         substr(sha256(coalesce(url, '')), 1, 2) AS lot
  FROM pages
), records AS (
  SELECT page_id, {_record_sql("body")} AS data,
         CASE WHEN lot IN {LOST} THEN ''
              WHEN lot IN {ROTTEN} THEN sha256({_record_sql("('#' || substr(body, 2))")})
              ELSE sha256({_record_sql("body")}) END AS replica
  FROM pages_
), placed AS (
  SELECT page_id, replica, sha256(data) AS digest, strlen(data) AS length,
         sum(strlen(data)) OVER (ORDER BY page_id NULLS FIRST, replica, sha256(data)
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - strlen(data) AS place
  FROM records
)
SELECT CAST(place // {ARCHIVE_BYTES} AS BIGINT) AS archive, CAST(place % {ARCHIVE_BYTES} AS BIGINT) AS "offset",
       page_id, CAST(length AS BIGINT) AS length,
       CASE WHEN replica = '' THEN 'missing' ELSE 'altered' END AS status
FROM placed WHERE replica <> digest
"""
