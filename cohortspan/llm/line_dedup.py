"""Line dedup: lines that several documents share stay only in the document with the largest id.

Hashes of line keys are range-partitioned, with a secondary sort by document and position; the
sorted rows are read once to find where a document first shows a key. What comes back is one bitmap
of dropped lines per document (cut behind its last set bit, absent where nothing is dropped), not
text. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspan.llm.common import SPACE, packed_rows, partitions, row_hash, table, text_or_empty, unpacked_rows
from cohortspan.llm.registry import query

#: A-Z lower-cased, nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines in one chunk of a bitmap, as Spark's bitmap functions lay it out.
CHUNK = 32768

_BITS = "array<struct<chunk:bigint,bits:binary>>"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def lower_ascii_bytes(key: Column) -> Column:
    """A text that differs exactly where the A-Z-lower-cased keys differ; only to be hashed.

    The UTF-8 bytes read as Latin-1 are lower-cased: A-Z go to a-z. Lead bytes C0-DE move to E0-FE,
    where they stay apart from others by the number of bytes that follow.
    """
    return F.when(
        F.octet_length(key) == F.length(key), F.lower(key)
    ).otherwise(F.lower(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1")))


def keyed_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points."""
    key = line_key(F.col("line"))
    folded = lower_ascii_bytes(F.col("key"))
    return (
        documents.select("doc_id", row_hash().alias("row"), F.posexplode(lines_of(text_or_empty())).alias("pos", "line"))
        .select("doc_id", "row", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row", "pos", folded.alias("key"))
        .select(
            F.xxhash64("key").alias("k1"),
            F.xxhash64(F.lit("second"), "key").alias("k2"),
            "doc_id",
            "row",
            "pos",
        )
    )


def dropped_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Bitmaps of dropped lines: doc_id, row (hash of the text), dropped.

    Lines are compared by key: stripped of ASCII white space at both ends, A-Z lower-cased. A key of
    at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines in
    all of them but the one with the largest id. ``dropped`` holds, for each chunk of 32,768 lines
    that loses one, a bitmap cut behind its last set byte.

    Rows with one doc_id are one document; rows without a doc_id are together one document that
    precedes all others. Null texts have one empty line. Documents that lose nothing have no row.

    A key in a third of all rows is spread: rows are ranged by key and a salt of the document (as
    many salts as shuffle partitions), each part is read in order and gives one row, and those rows
    are added up. The rows then meet the shared keys in an equi-join; ``split`` is a join key of its own, so
    that both sides are exchanged for the join and Spark can split a hot key.
    """
    n = partitions(documents.sparkSession)
    lines = keyed_lines(documents, min_chars).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    ranged = lines.repartitionByRange(n, "k1", "k2", "salt")
    part = Window.partitionBy("k1", "k2", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "pos", "row")
    before = F.lag(F.struct("doc_id")).over(part)
    first = before.isNull() | ~before["doc_id"].eqNullSafe(F.col("doc_id"))
    totals = (
        ranged.withColumn("first", first)
        .where("first")
        .groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("docs"), F.max(F.struct("doc_id", "pos", "row")).alias("last"))
        .where(F.col("docs") >= min_docs)
        .select("k1", "k2", F.col("last.doc_id").alias("stays"), F.xxhash64("k1", "k2").alias("split"))
    )
    lost = (
        ranged.withColumn("split", F.xxhash64("k1", "k2"))
        .join(totals, ["k1", "k2", "split"])
        .where(~F.col("doc_id").eqNullSafe(F.col("stays")))
        .select("doc_id", "row", "pos")
    )
    chunk = (F.col("pos") / CHUNK).cast("bigint")
    bits = F.expr("bitmap_construct_agg(CAST(bit AS BIGINT))")
    return (
        lost.select("doc_id", "row", chunk.alias("chunk"), (F.col("pos") % CHUNK).alias("bit"))
        .groupBy("doc_id", "row", "chunk")
        .agg(bits.alias("bits"), F.max("bit").alias("top"))
        .select("doc_id", "row", "chunk", F.expr("substring(bits, 1, CAST(top DIV 8 + 1 AS INT))").alias("bits"))
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "bits"))).alias("dropped"))
    )


def is_dropped(dropped: Column, pos: Column) -> Column:
    """Whether the bit of a line is set."""
    chunk = F.get(F.filter(dropped, lambda c: c["chunk"] == (pos / CHUNK).cast("bigint")), F.lit(0))["bits"]
    at = pos % CHUNK
    byte = F.substring(chunk, (at / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.getbit(value, (at % 8).cast("int")) == 1, F.lit(False))


def apply_dropped(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """d (the row as a struct), lines (all, an array) and kept (those whose bit is not set)."""
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (row_hash("d.text") == F.col("x.row"))
    lines = lines_of(text_or_empty("d.text"))
    some = F.filter(lines, lambda line, i: ~is_dropped(F.col("x.dropped"), i))
    return (
        packed_rows(documents)
        .join(bitmaps.alias("x"), same, "left")
        .select("d", lines.alias("lines"), F.when(F.col("x.dropped").isNull(), lines).otherwise(some).alias("kept"))
    )


def line_dedup(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents without the lines that ``dropped_lines`` marks; all columns and rows are kept."""
    marked = apply_dropped(documents, dropped_lines(documents, min_chars, min_docs))
    return unpacked_rows(marked, documents, text=F.array_join("kept", "\n"))


SQL = """
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.stays AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size("lines").cast("long")
    return apply_dropped(documents, dropped_lines(documents)).select(
        "d.doc_id",
        n_lines.alias("n_lines"),
        (n_lines - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )
