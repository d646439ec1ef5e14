"""Exact dedup of 400-byte strings by prefix-free parsing.

A rolling hash over 16 bytes sets triggers, which cut every text into phrases: equal strings are cut
alike. The dictionary is what phrases begin with, the parse their sequence. A string of 400 bytes is
the end of one phrase (before its first trigger) and the parse from there on; so strings are equal if
a suffix in the dictionary's order and a suffix in the parse's order agree deep enough.

1. Phrase heads are counted, as narrow rows. Strings whose head occurs once occur once themselves.
2. Places of the other heads are packed, with the bytes that strings around them need, and sent to
   the head's bucket. There the bytes before the trigger are sorted backwards (dictionary suffixes),
   those behind it forwards (parse suffixes), each with common-prefix lengths of neighbours. For every
   offset of the trigger, the two orders give classes of equal strings without comparing bytes again.
3. A head with more places than a task should hold is salted by document; its strings then meet
   others of their parts by a 128-bit hash, pre-aggregated.
4. Repeated starts go back to their documents as runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import (
    as_text,
    beside_documents,
    numbered_values,
    partitions,
    split_join,
    stored,
    table,
)
from cohortspan.llm.registry import query
from cohortspan.llm.shingles import mixed

#: Bytes in a string that may repeat.
LENGTH = 400
#: Bytes under the rolling hash, bytes of a phrase head, and one trigger in so many places.
TRIGGER, HEAD, SPARSE = 16, 64, 96
#: Places of one head in one part, and places that a bucket task sorts at once.
PART, SORTED = 4096, 1 << 14


def _eights(data: np.ndarray) -> np.ndarray:
    """Each 8 bytes as one number."""
    pairs = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
    fours = pairs[:-2] | (pairs[2:] << np.uint64(16))
    return fours[:-4] | (fours[4:] << np.uint64(32))


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """A hash for each 16 bytes."""
    if len(data) < TRIGGER:
        return np.zeros(0, np.uint64)
    eights = _eights(data)
    return mixed(eights[:-8] * np.uint64(0x9E3779B97F4A7C15) + (eights[8:] ^ (eights[8:] >> np.uint64(29))))


def phrase_places(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, trigger, head) of strings of ``length`` that share a trigger.

    A string's trigger is the first place in it where the rolling hash is a multiple of ``SPARSE``
    and a whole head follows inside; failing that, the place of the smallest hash (the leftmost).
    Either depends on the string alone.
    """
    strings = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if strings <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64)
    reach = length - HEAD
    hashes = rolling_hashes(data)
    usable = hashes[: strings + reach]
    triggers = np.flatnonzero(usable % np.uint64(SPARSE) == 0)
    before = np.concatenate([[-1], triggers[:-1]]) if len(triggers) else empty
    last = np.minimum(triggers, strings - 1)
    first = np.maximum(before + 1, triggers - reach)
    some = first <= last
    firsts, lasts, places = [first[some]], [last[some]], [triggers[some]]
    # strings too far from the next trigger
    lows = np.concatenate([[0], triggers + 1])
    highs = np.minimum(np.append(triggers, strings + reach) - reach, strings)
    far = lows < highs
    for low, high in zip(lows[far].tolist(), highs[far].tolist()):
        for at in range(low, high, 8192):
            count = min(8192, high - at)
            views = np.lib.stride_tricks.sliding_window_view(hashes[at : at + count + reach], reach + 1)
            place = at + np.arange(count) + views.argmin(axis=1)
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            firsts.append(at + starts)
            lasts.append(at + np.append(starts[1:], count) - 1)
            places.append(place[starts])
    first, last, places = map(np.concatenate, (firsts, lasts, places))
    head = np.zeros(len(places), np.uint64)
    for at in range(0, HEAD, TRIGGER):
        head = mixed(head + hashes[places + at])
    return first, last, places, head


def _bytes_of(text) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", np.uint8)


def phrase_heads(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """head, doc_id, row, number (of the place in its document)."""
    return numbered_values(documents, "head", lambda text: phrase_places(_bytes_of(text), length)[3])


PACKED = "head bigint, parts bigint, doc_id string, row bigint, starts array<int>, before int, packed binary"


def packed_places(wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of PACKED for the listed places: the bytes of all strings that share the trigger, which
    stands ``before`` bytes behind their start. Equal places of a document are one row, with all
    their starts: a text that repeats a byte for long is a few rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: dict[tuple, list[int]] = {}
            for at, (doc_id, row, text, numbers, parts) in enumerate(
                zip(*[batch[c] for c in ("doc_id", "row", "text", "numbers", "parts")])
            ):
                data = _bytes_of(text)
                first, last, place, head = phrase_places(data, length)
                raw = data.tobytes()
                head = head.view(np.int64)
                for i, n in zip(numbers, parts):
                    a, t = int(first[i]), int(place[i])
                    key = (int(head[i]), int(n), doc_id, row, at, t - a, raw[a : int(last[i]) + length])
                    made.setdefault(key, []).append(a)
            rows = [(*key[:4], starts, *key[5:]) for key, starts in made.items()]
            yield pd.DataFrame(rows, columns=["head", "parts", "doc_id", "row", "starts", "before", "packed"])

    made = as_text(wanted, "row", "text", "numbers", "parts").mapInPandas(run, PACKED)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


@dataclass
class Place:
    """A row of PACKED, as a bucket holds it."""

    salted: bool
    doc_id: str | None
    row: int
    starts: list[int]
    before: int
    packed: bytes


def _order(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and the common prefix of each with the one before (0 for the first)."""
    order = np.array(sorted(range(len(values)), key=values.__getitem__))
    padded = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)
    unlike = padded[order[1:]] != padded[order[:-1]]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    return order, np.concatenate([[0], common])


def string_classes(places: list[Place], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset of the trigger: the places that have a string there, and its class.

    Two strings are equal if and only if their class and offset are.
    """
    before = np.array([p.before for p in places])
    least = before - np.array([len(p.packed) - length for p in places])
    reach = int(before.max())
    back, back_common = _order([p.packed[: p.before][::-1] for p in places], max(reach, 1))
    forth, forth_common = _order([p.packed[p.before :] for p in places], length)
    left, right = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    for offset in range(int(least.min()), reach + 1):
        has = np.flatnonzero((least <= offset) & (offset <= before))
        left[back] = np.cumsum(back_common < offset)
        right[forth] = np.cumsum(forth_common < length - offset)
        yield offset, has, left[has] * (len(places) + 1) + right[has]


FOUND = "part boolean, w1 bigint, w2 bigint, n bigint, doc_id string, row bigint, start int, count int"


def solved(places: list[Place], length: int) -> list[tuple]:
    """Rows of FOUND: runs of repeated starts, and, for salted places, a row for each string class."""
    found: list[tuple] = []
    weights = np.array([len(p.starts) for p in places])
    hits_at, hits_of = [], []
    for offset, has, classes in string_classes(places, length):
        if not len(has):
            continue
        _, first, member = np.unique(classes, return_index=True, return_inverse=True)
        total = np.bincount(member, weights=weights[has]).astype(np.int64)
        hit = has[total[member] > 1]
        hits_at.append(np.full(len(hit), offset))
        hits_of.append(hit)
        for k in np.flatnonzero([places[has[i]].salted for i in first]):
            place = places[has[first[k]]]
            at = place.before - offset
            string = place.packed[at : at + length]
            w = [int(np.uint64(xxhash.xxh3_64_intdigest(string, seed)).astype(np.int64)) for seed in (1, 2)]
            found.append((True, *w, int(total[k]), place.doc_id, place.row, place.starts[0] + at, 1))
    of = np.concatenate(hits_of) if hits_of else np.zeros(0, np.int64)
    offset = np.concatenate(hits_at) if hits_at else of
    at = np.array([p.before for p in places])[of] - offset
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    if len(of):
        begins = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]))
        for i, begin, count in zip(of[begins], at[begins], np.diff(np.append(begins, len(of)))):
            place = places[i]
            found += [(False, 0, 0, 0, place.doc_id, place.row, s + int(begin), int(count)) for s in place.starts]
    return found


def _sorted_buckets(packed: DataFrame, length: int) -> DataFrame:
    """Rows of FOUND; a head (or a part of one) is read whole, as many as fit are held."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in batches:
            for head, salt, parts, doc_id, row, starts, before, raw in batch.itertuples(index=False, name=None):
                if (head, salt) != last and len(held) >= SORTED:
                    yield pd.DataFrame(solved(held, length), columns=names)
                    held = []
                last = (head, salt)
                held.append(Place(parts > 1, doc_id, row, [int(s) for s in starts], before, raw))
        if held:
            yield pd.DataFrame(solved(held, length), columns=names)

    salt = F.pmod(F.xxhash64("doc_id", "row"), F.col("parts"))
    placed = packed.withColumn("salt", salt).repartition(partitions(packed.sparkSession), "head", "salt")
    sent = placed.sortWithinPartitions("head", "salt").select(
        "head", "salt", "parts", F.col("doc_id").cast("string"), "row", "starts", "before", "packed"
    )
    return sent.mapInPandas(run, FOUND).withColumn("doc_id", F.col("doc_id").cast("long"))


def repeated_starts(documents: DataFrame, length: int = LENGTH, part: int = PART) -> DataFrame:
    """doc_id, row, runs (start, count): starts, in UTF-8 bytes, of strings of ``length`` bytes that
    start anywhere else too, in the same document or another. Matches never cross documents.

    A repeated row is another place. Rows are known by doc_id (which may be null) and text. Texts
    shorter than ``length`` have no strings.
    """
    narrow = stored(phrase_heads(documents, length), "phrase-heads")
    common = (
        narrow.groupBy("head")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("head", F.ceil(F.col("n") / part).alias("parts"))
    )
    numbers = (
        split_join(narrow, common, ["head"])
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set(F.struct("number", "parts"))).alias("of"))
        .select("doc_id", "row", F.col("of.number").alias("numbers"), F.col("of.parts").alias("parts"))
    )
    packed = packed_places(beside_documents(documents, numbers, "inner"), length)
    found = stored(_sorted_buckets(packed, length), "repeated-strings")
    strings = found.where("part")
    again = strings.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    late = (
        split_join(strings.where("n = 1").drop("n"), again, ["w1", "w2"])
        .select("doc_id", "row", "start", "count")
    )
    runs = found.where("NOT part").select("doc_id", "row", "start", "count").unionByName(late)
    return runs.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "count"))).alias("runs"))


def without_strings(documents: DataFrame, runs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row, n_bytes, n_removed, n_spans, kept: the bytes that no listed string covers.

    ``kept`` is binary: a string may begin or end inside a character.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text, listed in zip(batch["text"], batch["runs"]):
                data, removed, spans = _bytes_of(text), 0, 0
                kept = data
                if listed is not None and len(listed):
                    edges = np.zeros(len(data) + 1, np.int64)
                    at = np.array([(r["start"], r["count"]) for r in listed])
                    np.add.at(edges, at[:, 0], 1)
                    np.add.at(edges, at[:, 0] + at[:, 1] + length - 1, -1)
                    free = np.cumsum(edges[:-1]) == 0
                    kept = data[free]
                    removed = len(data) - len(kept)
                    spans = int(np.sum(~free & np.concatenate([[True], free[:-1]])))
                made.append((len(data), removed, spans, kept.tobytes()))
            columns = pd.DataFrame(made, columns=["n_bytes", "n_removed", "n_spans", "kept"], index=batch.index)
            yield pd.concat([batch[["doc_id", "row"]], columns], axis=1)

    both = as_text(beside_documents(documents, runs, "left"), "row", "text", "runs")
    made = both.mapInPandas(
        run, "doc_id string, row bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def suffix_dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``without_strings`` of the ``repeated_starts``: judged on the input, not on what is left."""
    return without_strings(documents, repeated_starts(documents, length), length)


SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM docs)
), twice AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM (SELECT *, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT *, count(*) FILTER (WHERE before IS NULL OR i - before > 400)
          OVER (PARTITION BY doc_id ORDER BY i) AS span FROM twice)
  GROUP BY doc_id, span
), removed AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last,
    string_agg(kept, '' ORDER BY a) AS kept
  FROM (SELECT s.*, substr(h, 2 * start + 1, 2 * (a - start)) AS kept
        FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM spans) s
        JOIN docs USING (doc_id))
  GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN removed USING (doc_id)
"""


@query("op9_suffix_dedup", SQL)
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(documents).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
