"""Session settings and sizing helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, name: str = "cohortspan", **conf) -> SparkSession:
    """A session for tests and benchmarks; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``keys`` into an explicit number of partitions.

    Model rows are small in bytes and heavy in compute. Adaptive execution would coalesce them
    into a few tasks by byte size; an explicit count is left alone, and later grouping by a
    superset of ``keys`` needs no further shuffle. The count defaults to
    ``spark.sql.shuffle.partitions``, the setting a cluster job sizes to its data.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


#: Rows of a key that meet in one place; a key with more is dealt into blocks.
MET = 1024
#: Places where the rows of one key are counted.
COUNTED = 8


def large_keys(rows: DataFrame, names: Sequence[str], deal: str, most: int = MET, partitions: int | None = None) -> DataFrame:
    """``names, __blocks``: how many blocks a key with over ``most`` rows is dealt into, for all tasks.

    Rows are spread before they are counted, in ``COUNTED`` places for each key: where they lie, or by
    bytes, a task would hold as many keys as their compressed rows have room for.
    """
    names = list(names)
    place = F.expr(f"pmod(xxhash64(`{deal}`), {COUNTED})") if deal in rows.columns else F.lit(0)
    placed = spread(rows.select(*names, place.alias("__place")), [*names, "__place"], partitions)
    parts = placed.groupBy(*names, "__place").agg(F.count(F.lit(1)).alias("__rows"))
    counted = spread(parts.drop("__place"), names, partitions).groupBy(*names).agg(F.sum("__rows").alias("__rows"))
    return F.broadcast(counted.where(f"__rows > {most}").selectExpr(*names, f"CAST(ceil(__rows / {most}) AS BIGINT) AS __blocks"))


def meet(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    how: str = "left",
    safe: Sequence[str] = (),
    deal: str | None = None,
    counted: DataFrame | None = None,
    most: int = MET,
    partitions: int | None = None,
) -> DataFrame:
    """``left`` joined with ``right`` where both grow with the number of scenarios.

    Model rows compress so well that a table of millions passes for a small one and would be sent
    whole to the driver. So neither side is broadcast: both are spread and merged. ``safe`` names
    further columns to join on, in which nulls are equal.

    With ``deal``, a key that has very many rows in ``left`` (or in ``counted``, a cheaper table, which
    may lack some of the key's columns) is dealt into blocks by a hash of that column, and its rows of
    ``right`` go to each. Only such keys, one in ``most`` rows at most, are broadcast.
    """
    names = [*on, *safe]
    if deal is not None:
        rows = left if counted is None else counted
        names = [c for c in names if c in rows.columns]
        large = large_keys(rows, names, deal, most, partitions).alias("h")

        def with_blocks(df: DataFrame) -> DataFrame:
            same = [F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}")) for c in names]
            count = F.coalesce("h.__blocks", F.lit(1).cast("long")).alias("__blocks")
            return df.alias("d").join(large, same, "left").select("d.*", count)

        left = with_blocks(left).withColumn("__met", F.expr(f"pmod(xxhash64(`{deal}`), __blocks)"))
        right = with_blocks(right).withColumn("__met", F.expr("explode(sequence(0L, __blocks - 1L))"))
        left, right, on = left.drop("__blocks"), right.drop("__blocks"), [*on, "__met"]
    # structs of nulls are equal
    held = {f"__{c}": F.struct(c) for c in safe}
    left, right, at = left.withColumns(held), right.withColumns(held).drop(*safe), [*on, *held]
    found = spread(left, at, partitions).join(spread(right, at, partitions).hint("merge"), at, how)
    return found.drop("__met", *held)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of a query, inside ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, Spark must be local, and the folder is a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root}/{name}-{uuid.uuid4().hex}"
