"""MinHash near-dedup with circulant signatures, banding and exact verification.

Two permutations make a whole signature: the first scatters shingles over a ring of slots, the
second gives each slot a value; coordinate k of the signature reads the values k slots on, that is
the second permutation shifted by k. Bands of coordinates form buckets. Every link that counts is
confirmed on the full shingle sets.

1. Documents with equal shingle sets form a class, by a 128-bit digest; its smallest doc_id stands
   for it (pre-aggregated, so a set in a third of all rows costs one row by partition).
2. Class representatives meet in buckets by band. Buckets with the same members, which is what most
   bands of a group give, are counted once: by size, smallest id, and two sums over members.
3. A bucket is cut into parts of bounded size. A unit of work holds a part and a few pivots, members
   that go to every part of their bucket. It links its members exactly and returns a spanning forest,
   never all pairs. These links give first components, by rounds of joins.
4. Members of a bucket that a component already joins need no comparison with each other. What lies
   outside the bucket's largest component is cut into parts again and held against all members, so
   every pair that is not connected yet is compared: a bucket of n with u such members costs n * u.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import (
    keyed_texts,
    partitions,
    slices,
    split_join,
    stored,
    table,
    without_listed,
)
from cohortspan.llm.components import connected_components
from cohortspan.llm.registry import query
from cohortspan.llm.shingles import mixed, row_hashes, shingle_set, words_of

#: Slots of the ring, bands, and coordinates in a band. At similarity 0.85 a pair misses all bands
#: with probability (1 - 0.85 ** 4) ** 24 < 3e-8; at 0.8 it is 4e-6.
SLOTS, BANDS, ROWS = 1 << 20, 24, 4
#: Members in a part of a bucket, and members that go to each of its parts.
PART, PIVOTS = 256, 4
#: Shingles whose signature values are held at once.
_BLOCK = 1 << 15


@cache
def second_permutation(coordinates: int) -> np.ndarray:
    """A row for each slot: the values of the slots from there on, one for each coordinate."""
    ring = np.random.default_rng(1).permutation(SLOTS).astype(np.uint32)
    ring = np.concatenate([ring, ring[: coordinates - 1]])
    return np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set."""
    values = second_permutation(coordinates)
    slots = (mixed(shingles ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(SLOTS - 1)).astype(np.int64)
    parts = [values[slots[i : i + _BLOCK]].min(axis=0) for i in range(0, len(slots), _BLOCK)]
    return np.minimum.reduce(parts)


def band_keys(of: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    bands = of.astype(np.uint64).reshape(-1, ROWS)
    return row_hashes(bands)


SIGNATURES = "doc_id bigint, row bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"


def signatures(documents: DataFrame, bands: int = BANDS) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, a digest of the set and the band keys.

    A-Z count as a-z; a document with fewer than five words has its whole sequence as one shingle;
    without words the set is empty and has no bands.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc_ids, of_rows, texts = part.columns
            sizes, digests, keys = [], [], []
            for text in texts.to_pylist():
                shingles = shingle_set(words_of(text, fold=True))
                raw = shingles.tobytes()
                sizes.append(len(shingles))
                digests.append([xxhash.xxh3_64_intdigest(raw, seed) for seed in (1, 2)])
                keys.append(None)
                if len(shingles):
                    keys[-1] = band_keys(signature(shingles, bands * ROWS)).view(np.int64)
            d1, d2 = np.array(digests, np.uint64).view(np.int64).T
            columns = [pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2), pa.array(keys, pa.list_(pa.int64()))]
            names = ["doc_id", "row", "n_shingles", "d1", "d2", "bands"]
            yield pa.RecordBatch.from_arrays([doc_ids, of_rows, *columns], names)

    return keyed_texts(documents).select("doc_id", "row", "text").mapInArrow(run, SIGNATURES)


def shingle_table(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and shingles (packed 64-bit hashes) of the documents whose id is ``wanted``.

    Rows come sorted by id, so a row repeated many times is one set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for part in slices(batches):
            ids, sets = [], []
            for doc_id, text in zip(*[column.to_pylist() for column in part.columns]):
                if doc_id != last:
                    last, seen = doc_id, set()
                if text not in seen:
                    seen.add(text)
                    ids.append(doc_id)
                    sets.append(shingle_set(words_of(text, fold=True)).tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shingles"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the wanted ids grow with the documents: always a sorted merge, never a broadcast
    some = rows.join(wanted.distinct().hint("merge"), "doc_id", "left_semi")
    return some.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles binary")


class _Forest:
    """Union-find over positions, the smallest being the root."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as (id, id), of the links among sets: 100 * common >= percent * union.

    The set that agrees most with all others is held against them first. Sets it links to are one
    tree; only the others are then held against all, by counting common elements in an index.
    """
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets)
    by_element = np.argsort(elements, kind="stable")
    elements, owners = elements[by_element], owners[by_element]
    fresh = np.concatenate([[True], elements[1:] != elements[:-1]])
    number = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(elements))
    frequency = (ends - starts).astype(np.int64)

    def links_of(i: int) -> np.ndarray:
        at = np.searchsorted(elements[starts], sets[i])
        at = at[frequency[at] > 1]
        if len(at) == 0:
            return np.zeros(0, np.int64)
        runs = frequency[at]
        places = np.repeat(starts[at] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        common = np.bincount(owners[places], minlength=len(sets))
        return np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common))

    forest = _Forest(len(sets))
    popularity = np.bincount(owners, weights=frequency[number], minlength=len(sets)) / np.maximum(sizes, 1)
    center = int(np.argmax(popularity))
    tree = links_of(center)
    for j in tree:
        forest.union(center, int(j))
    inside = np.zeros(len(sets), bool)
    inside[tree] = inside[center] = True
    for i in np.flatnonzero(~inside):
        for j in links_of(int(i)):
            forest.union(int(i), int(j))
    return [(int(ids[forest.root(i)]), int(ids[i])) for i in range(len(sets)) if ids[forest.root(i)] != ids[i]]


def _links_in_units(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in units of work; ``members`` has unit, doc_id and shingles."""

    def solved(unit: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        ids = np.array([doc_id for doc_id, _ in unit], np.int64)
        return linked(ids, [np.frombuffer(raw, np.uint64) for _, raw in unit], percent)

    def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit, found = [], None, []
        for part in slices(batches):
            for key, doc_id, raw in zip(*[column.to_pylist() for column in part.columns]):
                if key != unit:
                    if len(held) > 1:
                        found += solved(held)
                    held, unit = [], key
                held.append((doc_id, raw))
            if found:
                yield links(found)
                found = []
        if len(held) > 1:
            yield links(solved(held))

    sorted_units = members.repartition(partitions(members.sparkSession), "unit").sortWithinPartitions("unit")
    return sorted_units.select("unit", "doc_id", "shingles").mapInArrow(run, "a bigint, b bigint")


def bucket_members(classes: DataFrame, part: int = PART) -> DataFrame:
    """bucket, doc_id, parts (of the bucket), mine (its part), pivot, for buckets of two and more.

    ``classes`` has rep and bands. Pivots are the members with the least of ``PIVOTS`` hashes.
    """
    in_bands = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    tries = [F.xxhash64(F.lit(f"pivot {i}"), "rep") for i in range(PIVOTS)]
    buckets = (
        in_bands.groupBy("band", "key")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("rep").alias("least"),
            F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sum"),
            F.bit_xor(F.xxhash64(F.lit("xor"), "rep")).alias("xor"),
            *[F.min(of).alias(f"pivot{i}") for i, of in enumerate(tries)],
        )
        .where("size > 1")
        .groupBy("size", "least", "sum", "xor", *[f"pivot{i}" for i in range(PIVOTS)])
        .agg(F.min(F.struct("band", "key")).alias("bucket"))
        .select(
            "bucket.band",
            "bucket.key",
            F.ceil(F.col("size") / part).alias("parts"),
            F.array(*[f"pivot{i}" for i in range(PIVOTS)]).alias("pivots"),
        )
        .withColumn("split", F.xxhash64("band", "key"))
    )
    return (
        in_bands.withColumn("split", F.xxhash64("band", "key"))
        .join(buckets, ["band", "key", "split"])
        .select(
            F.xxhash64("band", "key").alias("bucket"),
            F.col("rep").alias("doc_id"),
            "parts",
            F.pmod(F.xxhash64("rep", "band"), F.col("parts")).alias("mine"),
            F.arrays_overlap(F.array(*tries), "pivots").alias("pivot"),
        )
    )


def first_units(members: DataFrame) -> DataFrame:
    """unit, doc_id: each part of a bucket with the bucket's pivots. A bucket of n is n rows, and
    ``PIVOTS`` for each part."""
    to = F.when(F.col("pivot"), F.expr("sequence(0L, parts - 1)")).otherwise(F.array("mine"))
    placed = members.select("bucket", "doc_id", F.explode(to).alias("part"))
    return placed.select(F.xxhash64("bucket", "part").alias("unit"), "doc_id")


def later_units(members: DataFrame, components: DataFrame, part: int = PART) -> DataFrame:
    """unit, doc_id: what ``components`` (node, component) leaves to compare in buckets of many parts.

    Members outside the largest component of their bucket, in parts, against all parts of the bucket.
    """
    nodes = components.select(F.col("node").alias("doc_id"), "component")
    big = split_join(members.where("parts > 1"), nodes, ["doc_id"], "left").select(
        "bucket", "doc_id", "parts", "mine", F.coalesce("component", "doc_id").alias("component")
    )
    big = stored(big, "large-buckets")
    open_buckets = (
        big.groupBy("bucket", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket")
        .agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"))
        .select("bucket", F.col("most.component").alias("main"), (F.col("all") - F.col("most.n")).alias("rest"))
        .where("rest > 0")
        .select("bucket", "main", F.ceil(F.col("rest") / part).alias("rests"))
    )
    both = split_join(big, open_buckets, ["bucket"])
    every = both.select(
        "bucket", "doc_id", F.col("mine").alias("part"), F.explode(F.expr("sequence(0L, rests - 1)")).alias("rest")
    )
    rest = (
        both.where("component <> main")
        .withColumn("rest", F.pmod(F.xxhash64(F.lit("rest"), "doc_id"), F.col("rests")))
        .select("bucket", "doc_id", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "rest")
    )
    return every.unionByName(rest).select(F.xxhash64("bucket", "part", "rest").alias("unit"), "doc_id")


def similar_classes(documents: DataFrame, classes: DataFrame, percent: int, part: int = PART) -> DataFrame:
    """node, component of the linked ``classes`` (rep, bands)."""
    members = stored(bucket_members(classes, part), "members")
    sets = stored(shingle_table(documents, members.select("doc_id")), "shingle-sets")

    def links(units: DataFrame) -> DataFrame:
        return _links_in_units(split_join(units, sets, ["doc_id"]), percent)

    found = connected_components(links(first_units(members)))
    later = stored(links(later_units(members, found, part)), "later-links")
    if later.isEmpty():
        return found
    return connected_components(later.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def near_duplicates(
    documents: DataFrame, percent: int = 80, bands: int = BANDS, part: int = PART
) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept for every row of ``documents``.

    Documents are linked where 100 * common >= percent * union of their shingle sets. component_id
    is the smallest doc_id reachable, kept says that it is the row's own. Empty sets are linked with
    nothing. Repeated rows share a class. Rows that repeat a doc_id with another text go by their own
    text; where that id stands for both classes these are one node. Rows without a doc_id are linked
    with nothing, have no component_id and are kept. Other columns play no part. A text is held whole
    in a task, and a unit of work holds the sets, 8 bytes a shingle, of two parts at most.
    """
    rows = stored(signatures(documents, bands), "signatures")
    known = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(
        known.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "bands")).alias("of"))
        .select("d1", "d2", F.col("of.doc_id").alias("rep"), F.col("of.bands").alias("bands")),
        "classes",
    )
    found = similar_classes(documents, classes.select("rep", "bands"), percent, part)

    by_class = classes.select("d1", "d2", "rep").join(found, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    tagged = rows.withColumn("split", F.xxhash64("d1", "d2")).join(
        by_class.withColumn("split", F.xxhash64("d1", "d2")), ["d1", "d2", "split"], "left"
    )
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id")))
    return tagged.select(
        "doc_id",
        "row",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def near_dedup(documents: DataFrame, percent: int = 80) -> DataFrame:
    """Documents without those that are not the first of their component; all columns are kept."""
    gone = near_duplicates(documents, percent).where(~F.col("kept")).select("doc_id", "row").distinct()
    return without_listed(documents, gone)


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op4_minhash_dedup", SQL)
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(documents, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
