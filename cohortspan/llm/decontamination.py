"""Benchmark decontamination: MinHash containment search in size partitions, verified exactly.

A document's shingles that no benchmark item has cannot change how much of an item it contains, so a
filter of all item shingles (of a fixed size, whatever the benchmark's) first reduces each document
to the few it may share. What is left is partitioned by size. In a partition with at most ``u``
shingles, a document that contains a share ``t`` of an item of ``q`` shingles has Jaccard similarity
of at least ``t q / (u + q - t q)``; that fixes how many MinHash coordinates the partition needs to
find it. Where that number exceeds ``u``, the partition emits its shingles themselves. Candidates
are confirmed on whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import row_hash, slices, stored, table, without_listed
from cohortspan.llm.minhash_dedup import signature
from cohortspan.llm.registry import query
from cohortspan.llm.shingles import shingle_set, words_of

#: Bits of the filter. A larger benchmark lets more shingles through; results stay the same.
FILTER_BITS = 1 << 24
#: Probability that the coordinates of a partition miss a document at the threshold.
MISS = 1e-9
#: Longest signature that is computed; a partition that needs more emits its shingles, which find all.
LONGEST = 4096

_CHUNK = 32768


def _sets(rows: DataFrame, key: str, kept=None) -> DataFrame:
    """key, row, n (size of the whole shingle set), shingles: those that ``kept`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, of_rows, texts = part.columns
            at, sizes, found = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                shingles = shingle_set(words_of(text, fold=True))
                some = shingles if kept is None else shingles[kept(shingles)]
                if len(some):
                    at.append(i)
                    sizes.append(len(shingles))
                    found.append(some.view(np.int64))
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *found]))
            taken = pa.array(at, pa.int64())
            columns = [ids.take(taken), of_rows.take(taken), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, [key, "row", "n", "shingles"])

    texts = rows.select(F.col(key).cast("long"), row_hash().alias("row"), F.col("text").cast("string"))
    schema = f"{key} bigint, row bigint, n bigint, shingles array<bigint>"
    return texts.mapInArrow(run, schema).distinct()


class _Filter:
    """A Bloom filter of item shingles: two bits for each, ``bits`` in all."""

    def __init__(self, items: DataFrame, bits: int) -> None:
        # a bit is chosen by the low half of a mixed shingle and by its high half
        low = F.expr(f"shingle & {bits - 1}")
        high = F.expr(f"shiftrightunsigned(shingle, 32) & {bits - 1}")
        places = items.select(F.explode("shingles").alias("shingle")).select(F.explode(F.array(low, high)).alias("at"))
        chunks = (
            places.select(F.expr(f"at DIV {_CHUNK}").alias("chunk"), F.expr(f"at % {_CHUNK}").alias("bit"))
            .groupBy("chunk")
            .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
        )
        table = np.zeros(bits // 8, np.uint8)
        for row in chunks.collect():  # at most bits / 32,768 rows of 4 KB
            table[row["chunk"] * (_CHUNK // 8) :][: _CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
        self.mask = np.uint64(bits - 1)
        self.table = items.sparkSession.sparkContext.broadcast(table)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        table = self.table.value

        def is_set(at: np.ndarray) -> np.ndarray:
            at = (at & self.mask).astype(np.int64)
            return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1

        return (is_set(shingles) & is_set(shingles >> np.uint64(32))).astype(bool)


def coordinates(item_class: int, size_class: int, percent: int, miss: float = MISS) -> int | None:
    """MinHash coordinates by which sets of a size class find items of a class, or None where their
    shingles themselves are fewer (or the signature is longer than any that is computed). A class ``c`` has sizes above 2 ** (c - 1), up to 2 ** c."""
    most, least = 2**size_class, 2 ** (item_class - 1) + 1 if item_class else 1
    share = percent / 100
    similarity = share * least / (most + least - share * least)
    needed = math.ceil(math.log(miss) / math.log1p(-min(similarity, 1 - 1e-12)))
    return needed if needed < min(most, LONGEST) else None


def _possible(item_class: int, size_class: int, percent: int) -> bool:
    """Whether a set of the size class can contain enough of an item of the other."""
    return 100 * 2**size_class >= percent * (2 ** (item_class - 1) + 1 if item_class else 1)


def _size_class(size: int) -> int:
    return (size - 1).bit_length()


def _classes(sets: DataFrame) -> list[int]:
    """The size classes that occur: one number for each power of two."""
    size_class = F.length(F.bin(F.size("shingles").cast("long") - 1))
    size_class = F.when(F.size("shingles") > 1, size_class).otherwise(0)
    return sorted(r[0] for r in sets.select(size_class).distinct().collect())


def _emitted(
    sets: DataFrame, key: str, item_classes: list[int], size_classes: list[int], percent: int, is_item: bool
) -> DataFrame:
    """key, row, kind, value: what the sets are looked up by. Kind -1 are shingles, others stand for
    an item class and a coordinate."""

    def wanted(size: int) -> tuple[bool, dict[int, int]]:
        """Whether shingles are emitted, and how many coordinates for which item classes."""
        own = [_size_class(size)]
        pairs = [(e, c) for e in (own if is_item else item_classes) for c in (size_classes if is_item else own)]
        needs = {(e, c): coordinates(e, c, percent) for e, c in pairs if _possible(e, c, percent)}
        found = {e: max([n for (x, _), n in needs.items() if x == e and n], default=0) for e, _ in needs}
        return None in needs.values(), {e: n for e, n in found.items() if n}

    def looked_up_by(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain, needs = wanted(len(shingles))
        kinds, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if plain:
            kinds.append(np.full(len(shingles), -1))
            values.append(shingles)
        if most := max(needs.values(), default=0):
            of = signature(shingles.view(np.uint64), 1 << (most - 1).bit_length())
            for e, n in needs.items():
                kinds.append(e * (1 << 24) + np.arange(n))
                values.append(of[:n].astype(np.int64))
        return np.concatenate(kinds), np.concatenate(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, of_rows, lists = part.columns
            found = [looked_up_by(x.values.to_numpy()) for x in lists]
            at = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
            kinds, values = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found))
            columns = [ids.take(at), of_rows.take(at), pa.array(kinds), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, [key, "row", "kind", "value"])

    schema = f"{key} bigint, row bigint, kind bigint, value bigint"
    return sets.select(key, "row", "shingles").mapInArrow(run, schema)


def contained_items(
    documents: DataFrame, benchmark: DataFrame, percent: int = 80, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """doc_id, row, item_id, n_item_shingles, n_common: items whose shingles a document contains to
    at least ``percent``.

    Words are runs outside [\\x20\\x09-\\x0D], A-Z count as a-z, shingles have five words; a text with
    fewer has its whole sequence as one shingle, so a short item is found in equal texts only. Items
    and documents without words are in no pair. Repeated rows give a pair once, null ids stay null.
    The benchmark may be of any size: only the filter, of ``filter_bits``, goes to every task.
    """
    items = stored(_sets(benchmark, "item_id"), "items").withColumnRenamed("row", "item_row")
    held = stored(_sets(documents, "doc_id", _Filter(items, filter_bits)), "shared-shingles")
    classes = [_classes(items), _classes(held)]
    from_docs = _emitted(held, "doc_id", *classes, percent, is_item=False)
    renamed = items.withColumnRenamed("item_row", "row")
    from_items = _emitted(renamed, "item_id", *classes, percent, is_item=True).withColumnRenamed("row", "item_row")
    candidates = (
        from_docs.withColumn("split", F.xxhash64("kind", "value"))
        .join(from_items.withColumn("split", F.xxhash64("kind", "value")), ["kind", "value", "split"])
        .select("doc_id", "row", "item_id", "item_row")
        .distinct()
    )
    d, i, c = held.alias("d"), items.alias("i"), candidates.alias("c")
    found = c.join(
        d, F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.row") == F.col("d.row"))
    ).join(i, F.col("c.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("c.item_row") == F.col("i.item_row")))
    common = F.size(F.array_intersect("d.shingles", "i.shingles")).cast("long")
    return (
        found.select("c.doc_id", "c.row", "c.item_id", F.col("i.n").alias("n_item_shingles"), common.alias("n_common"))
        .where(100 * F.col("n_common") >= percent * F.col("n_item_shingles"))
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Documents that contain no benchmark item; all columns are kept."""
    found = contained_items(documents, benchmark, percent).select("doc_id", "row").distinct()
    return without_listed(documents, found)


SQL = """
WITH words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM words)
), sizes AS (
  SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id
)
SELECT d.id AS doc_id, i.id AS item_id, z.n AS n_item_shingles, count(*) AS n_common
FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id, z.n HAVING 100 * count(*) >= 80 * z.n
"""


@query("op3_decontamination", SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return contained_items(documents, benchmark).select("doc_id", "item_id", "n_item_shingles", "n_common")
