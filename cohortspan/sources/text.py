"""Delimited text read as text and typed afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_table(
    spark: SparkSession,
    path: str | list[str],
    separator: str = ",",
    header: bool = True,
    present: str | None = None,
    uniform: bool = False,
) -> DataFrame:
    """A delimited file, or folders of them, with every cell as trimmed text and blanks as null.

    Rows shorter than the header are completed with nulls. Column names are trimmed too. Files may
    have different headers: each is read by its own, and columns that it lacks are null. Finding the
    headers is a pass over the first lines, when the table is read; ``uniform`` promises that there is
    one header and saves it. ``present`` names an array column that says which columns a row's file
    has, unless the files have it.
    """
    paths = [path] if isinstance(path, str) else path
    groups = {} if uniform or not header else _files_by_header(spark, paths)
    if len(groups) < 2:
        groups = {"": paths}
    frames = []
    for files in groups.values():
        one = _read_files(spark, paths, files, separator, header)
        if present is not None and present not in one.columns:
            one = one.withColumn(present, F.array(*[F.lit(c) for c in one.columns]))
        frames.append(one)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _files_by_header(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files by their first line: a row for each header, with as many paths as Spark lists to read."""
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start")
    firsts = lines.where("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("header"))
    headers = firsts.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files"))
    return {row["header"]: row["files"] for row in headers.orderBy("header").collect()}


def _read_files(
    spark: SparkSession, paths: list[str], files: list[str], separator: str, header: bool
) -> DataFrame:
    reader = (
        spark.read.option("header", header)
        .option("sep", separator)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .option("inferSchema", False)
    )
    if files != paths and len(paths) == 1:
        reader = reader.option("basePath", paths[0])  # keeps the columns that folders stand for
    raw = reader.csv(files)
    blank = F.lit("")
    return raw.select(
        *[
            F.nullif(F.trim(F.col(f"`{c}`")), blank).alias(c.strip())
            if kind == "string"
            else F.col(f"`{c}`")
            for c, kind in raw.dtypes
        ]
    )


def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast the named columns that are present; cells that do not fit become null.

    Whole numbers may be written with a decimal point, as in ``"4.0"``.
    """

    def cast(name: str):
        kind = columns.get(name)
        if kind is None or kind == "string":
            return F.col(name)
        text = F.trim(F.col(name).cast("string"))
        if kind in ("int", "bigint", "long"):
            return text.try_cast("double").try_cast(kind)
        return text.try_cast(kind)

    return df.select(*[cast(c).alias(c) for c in df.columns])
