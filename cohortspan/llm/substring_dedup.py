"""Substring dedup over word windows, partitioned by super-k-mers.

Each window of 20 words has a minimiser: the smallest hash among the 4-word grams inside. Consecutive
windows that share theirs travel as one packed string, to the bucket of the minimiser; equal windows
always meet there, where sorting finds which is first.

1. Super-k-mers are counted by minimiser, as narrow rows. Where a minimiser occurs once, its windows
   do too: they need not travel.
2. The others are packed and sent to buckets. A minimiser with more super-k-mers than a task should
   hold is salted by document; first windows of its parts then meet in a second, aggregated step.
3. Runs of repeated windows go back to their documents, which drop the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import beside_documents, keyed_texts, partitions, split_join, stored, table
from cohortspan.llm.registry import query
from cohortspan.llm.shingles import hashes_of, windows_of, words_of

#: Words in a window and in the grams that minimisers are chosen from.
WINDOW, GRAM = 20, 4
#: Super-k-mers of one minimiser in one part.
PART = 4096
#: Super-k-mers that a bucket task sorts at once, whole minimisers together.
SORTED = 1 << 15


@dataclass
class SuperKmers:
    """The super-k-mers of several documents: which document, first window, window behind the last,
    minimiser, and number in the document."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    minimiser: np.ndarray
    number: np.ndarray


def super_kmers(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> SuperKmers:
    """Of documents with ``sizes`` words, whose hashes stand one behind the other."""
    width = window - gram + 1
    grams = windows_of(hashes, gram)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[doc] + start
    if not len(at):
        none = np.zeros(0, np.int64)
        return SuperKmers(none, none, none, np.zeros(0, np.uint64), none)
    # windows across two documents are looked at too, and left out by ``at``
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    place = (np.arange(len(place)) + place)[at]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    length = np.diff(np.append(first, len(at)))
    of = doc[first]
    numbers = np.arange(len(of)) - np.searchsorted(of, of)
    return SuperKmers(of, start[first], start[first] + length, grams[place[first]], numbers)


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts one behind the other, and their number in each."""
    lists = [words_of(t) for t in texts.to_pylist()]
    return list(chain.from_iterable(lists)), np.array([len(w) for w in lists], np.int64)


def minimisers(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """minimiser, doc_id, row, number (of the super-k-mer in its document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch)):
            doc_ids, rows, texts = part.columns
            words, sizes = _words(texts)
            found = super_kmers(hashes_of(words), sizes, window, gram)
            at = pa.array(found.doc)
            columns = [
                pa.array(found.minimiser.view(np.int64)),
                doc_ids.take(at),
                rows.take(at),
                pa.array(found.number.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["minimiser", "doc_id", "row", "number"])

    texts = keyed_texts(documents).select("doc_id", "row", "text")
    return texts.mapInArrow(run, "minimiser bigint, doc_id bigint, row bigint, number int")


def packed_super_kmers(wanted: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """minimiser, parts, doc_id, row, start, words: the super-k-mers whose numbers are listed.

    ``wanted`` has documents with ``numbers`` and, beside each, the ``parts`` of its minimiser.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch)):
            doc_ids, rows, texts, numbers, parts = part.columns
            words, sizes = _words(texts)
            found = super_kmers(hashes_of(words), sizes, window, gram)
            doc = pa.array(np.repeat(np.arange(part.num_rows), numbers.value_lengths().to_numpy()))
            at = np.searchsorted(found.doc, doc.to_numpy()) + numbers.flatten().to_numpy()
            first = (np.cumsum(sizes) - sizes)[found.doc[at]] + found.start[at]
            last = first + found.end[at] - found.start[at] + window - 1
            joined = b" ".join(words)
            places = np.cumsum([0] + [len(w) + 1 for w in words])
            packed = [joined[a:b] for a, b in zip(places[first].tolist(), (places[last] - 1).tolist())]
            columns = [
                pa.array(found.minimiser[at].view(np.int64)),
                parts.flatten(),
                doc_ids.take(doc),
                rows.take(doc),
                pa.array(found.start[at].astype(np.int32)),
                pa.array(packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["minimiser", "parts", "doc_id", "row", "start", "words"])

    return wanted.select("doc_id", "row", "text", "numbers", "parts").mapInArrow(
        run, "minimiser bigint, parts bigint, doc_id bigint, row bigint, start int, words binary"
    )


FOUND = "first boolean, w1 bigint, w2 bigint, doc_id bigint, row bigint, start int, count int"


def _repeats(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Rows of FOUND from whole minimisers (or parts of one)."""
    packed = rows.column("words").to_pylist()
    # all words of all rows at once; windows across two rows are left out
    hashes = hashes_of(b" ".join(packed).split(b" "))
    sizes = np.array([p.count(b" ") + 1 for p in packed])
    counts = sizes - window + 1
    where = np.repeat(np.arange(len(packed)), counts)
    inside = np.arange(len(where)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[where] + inside
    w1, w2 = windows_of(hashes, window)[at], windows_of(hashes, window, seed=31)[at]
    starts = rows.column("start").to_numpy()[where] + inside
    doc_ids = rows.column("doc_id").combine_chunks()
    # null ids come first, as the smallest
    doc = doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy()[where]
    row = rows.column("row").to_numpy()[where]
    salted = rows.column("parts").to_numpy()[where] > 1
    order = np.lexsort((starts, row, doc, w2, w1))
    w1, w2, where, starts, doc, row, salted = (x[order] for x in (w1, w2, where, starts, doc, row, salted))
    fresh = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(w1)), 0))
    # the same place read twice, from a repeated row, isn't earlier than itself
    again = np.flatnonzero((doc != doc[first]) | (row != row[first]) | (starts != starts[first]))
    again = again[np.lexsort((starts[again], where[again]))]
    row_of, start_of = where[again], starts[again]
    begins = np.flatnonzero((np.diff(row_of, prepend=-1) != 0) | (np.diff(start_of, prepend=-2) != 1))
    lone = np.flatnonzero(fresh & salted)
    picked = np.concatenate([again[begins], lone])
    lengths = np.concatenate([np.diff(np.append(begins, len(again))), np.ones(len(lone), np.int64)])
    columns = [
        pa.array(np.arange(len(picked)) >= len(begins)),
        pa.array(w1[picked].view(np.int64)),
        pa.array(w2[picked].view(np.int64)),
        doc_ids.take(pa.array(where[picked])),
        pa.array(row[picked]),
        pa.array(starts[picked].astype(np.int32)),
        pa.array(lengths.astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])


def _sorted_buckets(packed: DataFrame, window: int) -> DataFrame:
    """Runs of repeated windows (first = false), and the first windows of salted parts (first = true).

    A row is read with its whole minimiser and part; only as many of these as fit are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SORTED:
                continue
            rows = pa.Table.from_batches(held)
            keys = [rows.column(c).to_numpy() for c in ("minimiser", "salt")]
            edges = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
            if len(edges):
                cut = int(edges[-1])
                yield _repeats(rows.slice(0, cut), window)
                held = rows.slice(cut).to_batches()
        if sum(b.num_rows for b in held):
            yield _repeats(pa.Table.from_batches(held), window)

    salt = F.pmod(F.xxhash64("doc_id", "row"), F.col("parts"))
    placed = packed.withColumn("salt", salt).repartition(partitions(packed.sparkSession), "minimiser", "salt")
    return placed.sortWithinPartitions("minimiser", "salt").mapInArrow(run, FOUND)


def repeated_runs(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, part: int = PART) -> DataFrame:
    """doc_id, row, starts, counts: runs of windows whose words also start earlier.

    Earlier is a smaller doc_id, or the same document and an earlier word; a null doc_id is smaller
    than any other, and rows that repeat a doc_id with another text are ordered by a hash of the
    text. Repeated rows are one place each. Documents shorter than a window have none. Window words
    are compared by 128-bit hashes.
    """
    narrow = minimisers(documents, window, gram)
    common = (
        narrow.groupBy("minimiser")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("minimiser", F.ceil(F.col("n") / part).alias("parts"))
    )
    numbers = (
        split_join(narrow, common, ["minimiser"])
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set(F.struct("number", "parts"))).alias("of"))
        .select("doc_id", "row", F.col("of.number").alias("numbers"), F.col("of.parts").alias("parts"))
    )
    packed = packed_super_kmers(beside_documents(documents, numbers, "inner"), window, gram)
    found = stored(_sorted_buckets(packed, window), "repeated-windows")
    firsts = found.where("first").select("w1", "w2", "doc_id", "row", "start").distinct()
    place = F.struct("doc_id", "row", "start")
    least = firsts.groupBy("w1", "w2").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = (
        split_join(firsts, least, ["w1", "w2"])
        .where(~place.eqNullSafe(F.col("least")))
        .select("doc_id", "row", "start", F.lit(1).alias("count"))
    )
    runs = found.where("NOT first").select("doc_id", "row", "start", "count").unionByName(late)
    return (
        runs.groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set(F.struct("start", "count"))).alias("of"))
        .select("doc_id", "row", F.col("of.start").alias("starts"), F.col("of.count").alias("counts"))
    )


def without_runs(documents: DataFrame, runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row, n_words, n_removed, text: words that no listed window covers, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch)):
            doc_ids, rows, texts, starts, counts = part.columns
            sizes, kept = [], []
            for text, start, count in zip(texts.to_pylist(), starts, counts):
                words = words_of(text)
                sizes.append(len(words))
                if start.is_valid:
                    start, count = start.values.to_numpy(), count.values.to_numpy()
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + count + window - 1, -1)
                    words = list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
                kept.append(words)
            removed = [n - len(k) for n, k in zip(sizes, kept)]
            joined = [b" ".join(k).decode("utf-8", "surrogatepass") for k in kept]
            columns = [doc_ids, rows, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_words", "n_removed", "text"])

    both = beside_documents(documents, runs, "left").select("doc_id", "row", "text", "starts", "counts")
    return both.mapInArrow(run, "doc_id bigint, row bigint, n_words bigint, n_removed bigint, text string")


def substring_dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``without_runs`` of the ``repeated_runs``: windows are judged on the input, not on what is left."""
    return without_runs(documents, repeated_runs(documents, window), window)


SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM words)
), late AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM late)
), parts AS (
  SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text, count(*) AS n
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i WHERE c.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op6_substring_dedup", SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(documents).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
