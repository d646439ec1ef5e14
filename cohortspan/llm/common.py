"""Reading tables, intermediate tables in the shared folder, and row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of every operator here, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
#: The same as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The shuffle width that a cluster job sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Cuts the lineage: what follows reads files that outlive any executor. Shuffles that made the
    table are of no more use and are removed once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_hash(name: str = "text") -> Column:
    """Tells apart rows that repeat a document id with another text."""
    return F.xxhash64(text_or_empty(name))


def without_listed(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """Documents that ``listed`` (doc_id, row) doesn't name; all columns are kept."""
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (row_hash("d.text") == F.col("x.row"))
    return unpacked_rows(packed_rows(documents).join(listed.alias("x"), same, "left_anti"), documents)


def keyed_texts(documents: DataFrame) -> DataFrame:
    """doc_id, row, text: a row is known by its id and a hash of its text."""
    return documents.select(F.col("doc_id").cast("long"), row_hash().alias("row"), F.col("text").cast("string"))


def as_text(df: DataFrame, *others: str) -> DataFrame:
    """doc_id as text: pandas would turn a nullable number into a float."""
    return df.select(F.col("doc_id").cast("string"), *others)


def beside_documents(documents: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents beside what ``lists`` has for them (doc_id, row, ...).

    Uses of the same documents exchange the texts alike, so one plan exchanges them once.
    """
    d, x = keyed_texts(documents).alias("d"), lists.alias("x")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.row") == F.col("x.row"))
    listed = [F.col(f"x.{c}") for c in lists.columns if c not in ("doc_id", "row")]
    return d.join(x, same, how).select("d.*", *listed)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` that Spark can split where a key is hot.

    A hash of the keys is a join key too. Neither side is laid out by it, so both are exchanged for
    the join alone, which is when adaptive execution may split a partition.
    """
    both = [F.xxhash64(*[F.col(f"{side}.{k}") for k in keys]) for side in "lr"]
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [both[0] == both[1]]
    more = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *more)


def packed_rows(documents: DataFrame) -> DataFrame:
    """Each row as one struct ``d``, so that names of helper columns cannot clash with any of its own."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"))


def unpacked_rows(rows: DataFrame, documents: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``documents`` again, some of them replaced."""
    return rows.select(*[replaced.get(c, F.col(f"d.`{c}`")).alias(c) for c in documents.columns])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: what they become may be many times as large."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mapped_column(
    documents: DataFrame, source: str, made: T.StructField, kind: pa.DataType, of: Callable[[], Callable]
) -> DataFrame:
    """``documents`` with a column computed from ``source``, in Arrow batches.

    ``of`` gives, once a task, a function from an Arrow array to one as long, of the given kind. A
    column named like the new one is replaced.
    """
    schema = T.StructType([f for f in documents.schema if f.name != made.name] + [made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = of()
        for batch in batches:
            # few rows at a time: what they become may be many times as large
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                place = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                result = value(place[source]).cast(kind)
                names = [n for n in place if n != made.name]
                yield pa.RecordBatch.from_arrays([*[place[n] for n in names], result], [*names, made.name])

    return documents.mapInArrow(run, schema)


def numbered_values(
    documents: DataFrame, name: str, of: Callable[[str | None], np.ndarray]
) -> DataFrame:
    """A row for each 64-bit value that ``of`` finds in a text: the value, doc_id, row, number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                doc_ids, rows, texts = part.columns
                values = [of(text.as_py()) for text in texts]
                sizes = [len(v) for v in values]
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                value = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
                number = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)]).astype(np.int32)
                columns = [pa.array(value), doc_ids.take(at), rows.take(at), pa.array(number)]
                yield pa.RecordBatch.from_arrays(columns, [name, "doc_id", "row", "number"])

    schema = f"{name} bigint, doc_id bigint, row bigint, number int"
    return keyed_texts(documents).select("doc_id", "row", "text").mapInArrow(run, schema)
