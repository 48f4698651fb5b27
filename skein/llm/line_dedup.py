"""Line dedup: of all equal lines of the corpus only those of the smallest document stay.

Line keys go as 128-bit hashes through one range partitioning with a secondary
sort by document and position; a running first value streams over every key and
tells later documents from the first one.  What comes back is not text but, per
document that loses lines, a bitmap of the lines to keep in words of 64 lines,
without the words of which every line stays.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import prepare, write_shared

LEAST_CHARS = 10  # code points of a key that takes part
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SECOND = 0x5DEECE66D  # seed of the second half of a hash
WORD = 64  # lines of a bitmap word

# Keys with more lines than GROUP_ROWS are split by a salt.  The counts come from a
# sketch of HOT_TRACKED counters: a key that it misses has less than about one line in
# HOT_TRACKED, and only the balance of the tasks depends on it, not the result.
GROUP_ROWS = 4096
HOT_KEYS, HOT_TRACKED = 1024, 16384


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered."""
    bare = F.btrim(line, F.lit(STRIP))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _digest(column: Column, name: str) -> list[Column]:
    return [F.xxhash64(column).alias(f"{name}1"), F.xxhash64(F.lit(SECOND), column).alias(f"{name}2")]


def _lines(column: Column) -> Column:
    return F.split(F.coalesce(column, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, t1, t2, row, pos, h1, h2) for every line whose key has ``least_chars`` code points or more.

    t is the digest of the whole text, h that of the line's key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = docs.select(
        F.col(id_col).alias("id"),
        *_digest(text, "t"),
        F.monotonically_increasing_id().alias("row"),
        F.posexplode_outer(_lines(F.col(text_col))).alias("pos", "line"),
    )
    keys = units.select("id", "t1", "t2", "row", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select("id", "t1", "t2", "row", "pos", *_digest(F.col("key"), "h"))


def _salted(lines: DataFrame) -> DataFrame:
    """``lines`` with ``salts``, the number of parts of the line's key, and ``salt``, the line's own."""
    sketch = F.explode(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {HOT_TRACKED})")).alias("hot")
    hot = lines.select(sketch).where(F.col("hot.count") > GROUP_ROWS)
    hot = hot.select(F.col("hot.item").alias("h1"), F.ceil(F.col("hot.count") / GROUP_ROWS).alias("salts"))
    found = lines.join(F.broadcast(hot), "h1", "left")  # HOT_KEYS rows at most
    return found.withColumns(
        {
            "salts": F.coalesce("salts", F.lit(1)),
            "salt": F.coalesce(F.pmod(F.xxhash64("row", "pos"), "salts"), F.lit(0)),
        }
    )


def lost_lines(lines: DataFrame) -> DataFrame:
    """(id, t1, t2, pos) of the lines whose key a document with a smaller id holds too.

    Every part of a key is streamed in the order of documents and positions, and
    its lines are later than the part's first document or of it.  The latter are
    few; for keys of several parts they are held against the least of the parts'
    first documents.
    """
    parts = _salted(lines).repartitionByRange("h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.asc_nulls_last("id"), "pos")
    first = F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = parts.withColumn("later", ~F.col("id").eqNullSafe(first))
    split = F.col("salts") > 1
    seen = seen.where(F.col("later") | split).select(
        "id", "t1", "t2", "pos", "later", F.when(split, F.col("h1")).alias("h1"), F.when(split, F.col("h2")).alias("h2")
    )
    seen = write_shared(seen, "later-lines")
    heads = seen.where(~F.col("later"))
    least = heads.groupBy("h1", "h2").agg(F.min("id").alias("least"))  # HOT_KEYS keys at most
    behind = heads.join(F.broadcast(least), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("least")))
    own = ["id", "t1", "t2", "pos"]
    return seen.where("later").select(*own).unionByName(behind.select(*own))


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS
) -> DataFrame:
    """(id, t1, t2, n_dropped, keep) for every different (id, text) that loses lines.

    ``keep`` is an ascending array of (word, bits): bit b of word w is line
    64 w + b, numbered from 0; words of which every line stays are left out.
    (t1, t2) is the digest of the text.

    Of equal keys only the lines of the smallest id stay, all of them; a null id
    comes behind all others.  Rows that repeat an id are one document: their
    lines don't drop each other's.  A null text is an empty one; an empty table
    gives no row; other columns are not read.
    """
    prepare(docs.sparkSession)
    lines = write_shared(line_hashes(docs, id_col, text_col, least_chars), "line-hashes")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD)
    lost = lost_lines(lines).select("id", "t1", "t2", F.floor(F.col("pos") / WORD).cast("int").alias("word"), bit.alias("bit"))
    words = lost.groupBy("id", "t1", "t2", "word").agg(F.bit_or("bit").alias("lost"))
    kept = F.struct("word", F.bitwise_not("lost").alias("bits"))
    return words.groupBy("id", "t1", "t2").agg(
        F.sum(F.bit_count("lost")).alias("n_dropped"), F.sort_array(F.collect_list(kept)).alias("keep")
    )


def _kept(lines: Column, keep: Column) -> Column:
    """The lines whose bits are set; one-element transforms name what else each line would work out anew."""
    last = F.floor((F.size(lines) - 1) / WORD).cast("int")

    def dense(sparse: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(sparse[w], F.lit(-1).cast("long")))

    def chosen(bits: Column) -> Column:
        def stays(_: Column, i: Column) -> Column:
            word = F.get(bits, F.floor(i / WORD).cast("int"))
            return F.call_function("shiftright", word, i % WORD).bitwiseAND(F.lit(1)) == 1

        return F.filter(lines, stays)

    words = F.transform(F.array(F.map_from_entries(keep)), dense)[0]
    return F.transform(F.array(words), chosen)[0]


def _applied(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, n_dropped, kept): each row of ``docs`` as a struct, with the number of lines lost and the text left."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("rid"), *_digest(text, "r"))
    same = F.col("rid").eqNullSafe(F.col("id")) & (F.col("r1") == F.col("t1")) & (F.col("r2") == F.col("t2"))
    found = rows.join(bitmaps, same, "left")
    old = F.col("row")[text_col]
    new = F.array_join(_kept(_lines(old), F.col("keep")), "\n")
    return found.select(
        "row", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.when(F.col("keep").isNull(), old).otherwise(new).alias("kept")
    )


def deduped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS
) -> DataFrame:
    """``docs`` with the lost lines taken out of its texts: the same columns, one row per row.

    See ``keep_bitmaps`` for what is lost.  A text that loses nothing, a null one
    too, stays as it is; one that loses all is empty.  Other columns pass
    through, whatever their names.
    """
    done = _applied(docs, keep_bitmaps(docs, id_col, text_col, least_chars), id_col, text_col)
    place = docs.columns.index(text_col)
    fields = [F.col("row")[c].alias(c) if i != place else F.col("kept").alias(c) for i, c in enumerate(docs.columns)]
    return done.select(*fields)


def op13_query(docs: DataFrame) -> DataFrame:
    done = _applied(docs, keep_bitmaps(docs), "doc_id", "text")
    return done.select(
        F.col("row")["doc_id"].alias("doc_id"),
        F.size(_lines(F.col("row")["text"])).cast("long").alias("n_lines"),
        "n_dropped",
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


OP13_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key
), marked AS (
  SELECT k.*, coalesce(k.doc_id > f.first, false) AS lost FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
