"""Ranked lexical search without random access (NRA), shard by shard.

Documents are dealt into shards of bounded size as they are read, with their counts of terms that
some query has. In a shard every query term has a list of documents by falling impact. Lists are read
from the top, each round some times as deep as the one before. What has been read gives each document
a lower score; its upper score adds, for every list that it wasn't met in, the highest impact not yet
read there. A query is done in a shard when no unmet document can reach the k-th lower score and all
that can have equal bounds, so that membership, ties and scores are final. The best of a task's
shards are kept from shard to shard, which raises the score to reach; only they leave the task.

Queries go to the tasks in blocks of a bounded number of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspan.llm.bloom import HashFilter
from cohortspan.llm.common import slices, stored, table
from cohortspan.llm.registry import query

#: Documents reported for each item.
TOP = 50
#: Bits of the filter of query terms.
FILTER_BITS = 1 << 24
#: Terms of queries that a task holds, and counts of terms in a shard.
BLOCK_TERMS, SHARD_COUNTS = 500_000, 2_000_000
#: Entries of each list that are read first, and how much deeper each further round reads.
FIRST_READ, DEEPER = 256, 3
_SALTS = 64

#: ASCII characters outside 0-9, A-Z and a-z separate terms; A-Z count as a-z.
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_SEPARATORS)
)


def term_counts(text: str | None, size: int = 1 << 20) -> Counter:
    """How often a text has each term; its words are listed a bounded part at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    found: Counter = Counter()
    begin = 0
    while begin < len(data):
        cut = data.find(b" ", begin + size)
        end = cut if cut >= 0 else len(data)
        found.update(data[begin:end].split())
        begin = end
    return found


def item_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """item, row, term: the distinct terms of each item. Rows that repeat an id with another text are
    items of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, texts = part.columns
            found = [list(term_counts(t)) for t in texts.to_pylist()]
            rows = [xxhash.xxh3_64_intdigest(t or "") >> 1 for t in texts.to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
            columns = [ids.take(at), pa.array(rows, pa.int64()).take(at), terms]
            yield pa.RecordBatch.from_arrays(columns, ["item", "row", "term"])

    own = items.select(F.col(key).cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "item bigint, row bigint, term string").distinct()


def _term_hashes(terms: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [xxhash.xxh3_64_intdigest(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(of, np.uint64).view(np.int64))], ["h"])

    return terms.select("term").mapInArrow(run, "h bigint")


def counted_documents(documents: DataFrame, wanted: HashFilter) -> DataFrame:
    """doc_id, n, terms, counts: documents with a term, and their counts of terms let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            ids, texts = part.columns
            at, sizes, terms, counts, lengths = [], [], [], [], []
            for i, text in enumerate(texts):
                found = term_counts(text.as_py())
                if not found:
                    continue
                own = list(found)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
                some = [own[j] for j in np.flatnonzero(wanted(hashes))]
                at.append(i)
                sizes.append(found.total())
                lengths.append(len(some))
                terms += some
                counts += map(found.__getitem__, some)
            offsets = pa.array(np.cumsum([0, *lengths]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ]
            columns = [ids.take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    own = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id bigint, n bigint, terms array<string>, counts array<bigint>")


@dataclass
class Lists:
    """Impact-sorted lists of a shard: entries of term ``t`` stand from ``starts[t]`` to ``starts[t + 1]``."""

    starts: np.ndarray
    docs: np.ndarray
    units: np.ndarray
    count: int

    @classmethod
    def of(cls, terms: np.ndarray, docs: np.ndarray, units: np.ndarray, kinds: int, count: int) -> Lists:
        order = np.lexsort((-units, terms))
        starts = np.searchsorted(terms[order], np.arange(kinds + 1))
        return cls(starts, docs[order], units[order], count)


def nearest(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 0) -> tuple[np.ndarray, int]:
    """Scores of a shard's documents that may be among the ``k`` best, 0 for others, and the number
    of list entries read. Documents with scores below ``least`` or 0 may be left out. Scores that are
    given are final."""
    begin, end = lists.starts[terms], lists.starts[terms + 1]
    some = (begin < end) & (weights > 0)
    begin, end, weights = begin[some], end[some], weights[some]
    lower = np.zeros(lists.count, np.int64)
    read = begin.copy()
    depth = FIRST_READ
    while True:
        upto = np.minimum(begin + depth, end)
        bounds = np.zeros(len(begin), np.int64)
        more = upto < end
        bounds[more] = weights[more] * lists.units[upto[more]]
        ahead = int(bounds.sum())
        upper = np.full(lists.count, ahead)
        for t in range(len(begin)):
            new = slice(read[t], upto[t])
            lower[lists.docs[new]] += weights[t] * lists.units[new]
            if bounds[t]:
                upper[lists.docs[begin[t] : upto[t]]] -= bounds[t]
        read = upto
        if not ahead:
            break
        reach = least
        if lists.count >= k:
            reach = max(reach, int(np.partition(lower, lists.count - k)[lists.count - k]))
        upper += lower
        # documents not met in any list have ``ahead`` as their upper score
        if ahead < reach and not np.any((upper > lower) & (upper >= reach)):
            lower[lower < reach] = 0
            break
        depth *= DEEPER
    return lower, int((read - begin).sum())


class _Best:
    """The best documents of each item among the shards of a task."""

    def __init__(self, count: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * count
        self.ids = [np.zeros(0, np.int64)] * count
        self.known = [np.zeros(0, bool)] * count

    def least(self, i: int) -> int:
        return int(self.scores[i][-1]) if len(self.scores[i]) == self.k else 0

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores = np.concatenate([self.scores[i], scores])
        ids, known = np.concatenate([self.ids[i], ids]), np.concatenate([self.known[i], known])
        # a missing id is smaller than any other
        order = np.lexsort((ids, known, -scores))[: self.k]
        self.scores[i], self.ids[i], self.known[i] = scores[order], ids[order], known[order]


def _ranked(counted: DataFrame, block: list, total: int, length: int, k: int, shard_counts: int) -> DataFrame:
    """item, row, doc_id, score: the best of each task for a block's (item, row, terms, weights)."""
    names = sorted({t for one in block for t in one["terms"]})
    number = {t: i for i, t in enumerate(names)}
    queries = [
        (np.array([number[t] for t in one["terms"]], np.int64), np.array(one["weights"], np.int64)) for one in block
    ]
    keys = [(one["item"], one["row"]) for one in block]
    sent = counted.sparkSession.sparkContext.broadcast((number, queries, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, queries, keys = sent.value
        best = _Best(len(queries), k)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def search() -> None:
            ids = pa.chunked_array([h[0] for h in held])
            known = np.asarray(ids.is_valid().combine_chunks())
            ids = ids.fill_null(0).to_numpy()
            sizes = [len(h[0]) for h in held]
            shift = np.repeat(np.cumsum([0, *sizes[:-1]]), [len(h[1]) for h in held])
            terms, docs, units = (np.concatenate([h[j] for h in held]) for j in (1, 2, 3))
            lists = Lists.of(terms, docs + shift, units, len(number), len(ids))
            for i, (own, weights) in enumerate(queries):
                scores, _ = nearest(lists, own, weights, k, best.least(i))
                at = np.flatnonzero(scores)
                best.add(i, scores[at], ids[at], known[at])
            held.clear()

        entries = 0
        for part in slices(batches, 1024):
            ids, n, terms, counts = part.columns
            of = terms.flatten().dictionary_encode()
            numbers = np.array([number.get(t, -1) for t in of.dictionary.to_pylist()], np.int64)
            found = numbers[of.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)
            docs = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
            tf = counts.flatten().to_numpy()
            m = 50 + (50 * n.to_numpy() * total) // length
            units = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
            some = found >= 0
            held.append((ids, found[some], docs[some], units[some]))
            entries += len(found)
            if entries >= shard_counts:
                search()
                entries = 0
        if held:
            search()
        for i, (item, row) in enumerate(keys):
            if size := len(best.ids[i]):
                columns = [pa.array([item] * size, pa.int64()), pa.array([row] * size, pa.int64())]
                columns.append(pa.array(best.ids[i], mask=~best.known[i]))
                columns.append(pa.array(best.scores[i]))
                yield pa.RecordBatch.from_arrays(columns, ["item", "row", "doc_id", "score"])

    return counted.mapInArrow(run, "item bigint, row bigint, doc_id bigint, score bigint")


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = TOP,
    block_terms: int = BLOCK_TERMS,
    shard_counts: int = SHARD_COUNTS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0.

    Ties go to the smaller doc_id, a missing one first. A null text has no terms: such an item finds
    nothing, such a document is found by nothing and not counted. Every row of ``documents`` is a
    document, so repeated rows take a rank each; of ``items`` equal rows are one. Other columns are
    ignored, empty tables give an empty one. A long text is read in bounded pieces.
    """
    wanted = stored(item_terms(items), "item-terms")
    counted = stored(
        counted_documents(documents, HashFilter(_term_hashes(wanted.select("term").distinct()), FILTER_BITS)),
        "counted-terms",
    )
    total, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.expr(f"CAST(floor(1000 * ln(CAST({2 * total + 2} AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)")
    blocks = max(1, -(-wanted.count() // block_terms))
    block = F.pmod(F.xxhash64("item", "row"), F.lit(blocks))
    queries = stored(
        wanted.join(held, "term")
        .groupBy("item", "row")
        .agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("own"))
        .select("item", "row", F.col("own.term").alias("terms"), F.col("own.w").alias("weights"), block.alias("block")),
        "queries",
    )
    found = None
    for b in range(blocks):
        # about ``block_terms`` terms; the blocks are equal shares of the items
        own = queries.where(F.col("block") == b).collect()
        some = _ranked(counted, own, total, length, k, shard_counts)
        some = stored(some, "ranked") if blocks > 1 else some
        found = some if found is None else found.unionByName(some)
    by = [F.desc("score"), F.asc_nulls_first("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "row", salt).orderBy(*by)))
    some = some.where(f"rank <= {k}")
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "row").orderBy(*by)))
    return last.where(f"rank <= {k}").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


SQL = """
WITH terms AS (
  SELECT kind, id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) AS term
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)
), counts AS (
  SELECT id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY ALL
), lengths AS (
  SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY id
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term, docs
), scores AS (
  SELECT i.id AS item_id, c.id AS doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM (SELECT DISTINCT id, term FROM terms WHERE kind = 'i') i
  JOIN counts c USING (term) JOIN weights USING (term) JOIN lengths l ON l.id = c.id, totals
  GROUP BY ALL
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0
) WHERE place <= 50
"""


@query("op11_lexical_search", SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
