"""Language-model scores by context-tree weighting over bytes.

The bytes of a text's tokens are predicted bit by bit. A context is the last ``depth`` bytes or any
shorter suffix of them, and has a binary tree of bits for the byte that follows; at each of its
nodes a Krichevsky-Trofimov estimate is mixed with what the next longer contexts say, by the weight
that the training data give to stopping there (Willems, Shtarkov and Tjalkens, 1995). The trained
tree is then kept fixed and scores every text.

The model is never held in one place. Texts are dealt into blocks of a fixed size; a block asks once
for each distinct gram (a full context and its byte) and each distinct word that it holds, so a word
in every text is asked for once a block. What is asked for is sorted into buckets, by the last bytes of
contexts and by a hash of words, and travels packed. A bucket sums up its counts; it weighs and walks
the subtrees of its contexts, whose size the alphabet bounds; the few levels above are joins. Answers
meet the texts of their block again, which adds them up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import partitions, slices, stored, table
from cohortspan.llm.registry import query

#: Longest context in bytes; at most 7, so that a gram fits 64 bits.
DEPTH = 5
#: Levels that are walked inside a bucket: a context there has at most 256 ** (BELOW + 1) grams under it.
BELOW = 2
#: Bytes of text in a block, and buckets for each shuffle partition.
BLOCK, BUCKETS = 16 << 20, 2
#: Bytes and grams that are worked on at once.
PIECE, BUNCH = 1 << 20, 1 << 17

#: Stands for the end of a text; no word holds it.
END = b"\n"
_HALF = np.log(0.5)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(text: str | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, a bounded part of the text at a time."""
    data = (text or "").encode("utf-8", "surrogatepass")
    begin = 0
    while begin < len(data):
        cut = _SPACE.search(data, begin + size) if begin + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[begin:end].lower().split()
        begin = end


class Grams:
    """Grams of the byte streams of texts: each word and a space, at last the end mark."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        self.parts: list[bytes] = []
        self.lengths: list[int] = []
        self.owners: list[int] = []
        self.size = 0

    def start(self) -> None:
        self.context = END * self.depth

    def add(self, owner: int, payload: bytes) -> None:
        self.parts += [self.context, payload]
        self.lengths.append(len(payload))
        self.owners.append(owner)
        self.size += len(payload)
        self.context = (self.context + payload[-self.depth :])[-self.depth :] if self.depth else b""

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The grams added since the last call, and the owner of each."""
        data = np.frombuffer(b"".join(self.parts), np.uint8)
        count = max(len(data) - self.depth, 0)
        grams = np.zeros(count, np.uint64)
        for k in range(self.depth + 1):
            grams = (grams << np.uint64(8)) | data[k : k + count]
        runs = np.full(2 * len(self.lengths), self.depth)
        runs[::2] = self.lengths
        own = np.repeat(np.arange(len(runs)) % 2 == 0, runs)[:count]
        owners = np.repeat(np.array(self.owners, np.int32), self.lengths)
        self.clear()
        return grams[own], owners


_NAMES, _KINDS = ["doc_id", "learns", "text"], [pa.int64(), pa.bool_(), pa.string()]


def _packed(names: list[str], columns: list[pa.Array]) -> bytes:
    """Rows compressed together, which takes far less room than single rows do."""
    batch = pa.RecordBatch.from_arrays(columns, names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(packed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def _unpacked(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int | None, bool, str | None]]:
    for one in texts:
        yield from zip(*(c.to_pylist() for c in _opened(one).columns))


def blocks_of(documents: DataFrame, learns: Column, block_bytes: int = BLOCK) -> DataFrame:
    """block, texts: neighbouring rows of a task share a block up to its size, in compressed parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size, held, room = TaskContext.get().partitionId() << 32, 0, [], 0

        def part() -> pa.RecordBatch:
            texts = _packed(_NAMES, [pa.array(c, k) for c, k in zip(zip(*held), _KINDS)])
            columns = [pa.array([block], pa.int64()), pa.array([texts], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["block", "texts"])

        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(row[2] or "")
                full = size and size + n > block_bytes
                if held and (full or room + n > 4 * PIECE):
                    yield part()
                    room = 0
                if full:
                    block, size = block + 1, 0
                held.append(row)
                size, room = size + n, room + n
        if held:
            yield part()

    rows = documents.select(
        F.col("doc_id").cast("long"), F.coalesce(learns, F.lit(True)).alias("learns"), F.col("text").cast("string")
    )
    return stored(rows.mapInArrow(run, "block bigint, texts binary"), "scored-texts")


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and the sums of their counts."""
    found, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(found)).astype(np.int64)


def _cut(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets that occur with the places of their keys, in order."""
    order = np.argsort(keys, kind="stable")
    ends = np.searchsorted(keys[order], np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(ends)):
        yield int(bucket), order[ends[bucket] : ends[bucket + 1]]


class _Asked:
    """Distinct grams and words of a block with their counts in texts that are learned from."""

    def __init__(self, depth: int, top: int, buckets: int) -> None:
        self.grams = {flag: Grams(depth) for flag in (True, False)}
        self.mask, self.buckets = np.uint64((1 << 8 * top) - 1), buckets
        self.found: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def add(self, text: str | None, learns: bool) -> None:
        own, words = self.grams[learns], self.words[learns]
        own.start()
        for found in word_lists(text):
            if found:
                own.add(0, b" ".join(found) + b" ")
            words.update(found)
            self.reduce(learns, PIECE)
        own.add(0, END)
        words[END] += 1

    def reduce(self, learns: bool, least: int) -> None:
        if self.grams[learns].size > least:
            found, n = np.unique(self.grams[learns].taken()[0], return_counts=True)
            self.found.append(found)
            self.counts.append(n if learns else 0 * n)
            if sum(map(len, self.found[1:])) > PIECE:
                found, n = _summed(self.found, self.counts)
                self.found, self.counts = [found], [n]

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        for flag in (True, False):
            self.reduce(flag, 0)
        grams, n = _summed(self.found, self.counts)
        made = []
        keys = ((grams >> np.uint64(8)) & self.mask) % np.uint64(self.buckets)
        for bucket, at in _cut(keys.astype(np.int64), self.buckets):
            made.append((bucket, True, _packed(["key", "n"], [pa.array(grams[at]), pa.array(n[at])])))
        held = self.words[False].keys() - self.words[True].keys()
        words = pa.array([*self.words[True], *held], pa.binary())
        n = np.array([*self.words[True].values(), *[0] * len(held)], np.int64)
        keys = np.fromiter((zlib.crc32(w) % self.buckets for w in words.to_pylist()), np.int64, len(words))
        for bucket, at in _cut(keys, self.buckets):
            at = np.sort(at)
            made.append((bucket, False, _packed(["key", "n"], [words.take(pa.array(at)), pa.array(n[at])])))
        for a in range(0, len(made), 256):
            bucket, is_gram, packed = zip(*made[a : a + 256])
            columns = [pa.array([block] * len(bucket), pa.int64()), pa.array(bucket, pa.int64())]
            columns += [pa.array(is_gram, pa.bool_()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "is_gram", "asked"])


def _asked(blocks: DataFrame, depth: int, top: int, buckets: int) -> DataFrame:
    """block, bucket, is_gram, asked: the distinct grams, or words, of a block that a bucket answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = None, None
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block != held:
                    if asked is not None:
                        yield from asked.rows(held)
                    held, asked = block, _Asked(depth, top, buckets)
                for _, learns, text in _unpacked(batch.column(1).slice(i, 1)):
                    asked.add(text, learns)
        if asked is not None:
            yield from asked.rows(held)

    return blocks.mapInArrow(run, "block bigint, bucket bigint, is_gram boolean, asked binary")


class GramTable:
    """Place of a gram among distinct ones, by open addressing; far fewer steps than a binary search."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = grams
        bits = max(int(2 * len(grams) - 1).bit_length(), 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(grams), dtype=np.int32), self._first(grams)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            put = self.slots[at] == left
            left, at = left[~put], (at[~put] + 1) & self.mask

    def _first(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """All of ``wanted`` must be in the table."""
        at = self._first(wanted)
        found = self.slots[at]
        left = np.flatnonzero(self.grams[found] != wanted)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.slots[at[left]]
            if (found[left] < 0).any():
                raise KeyError("a gram that was not asked for")
            left = left[self.grams[found[left]] != wanted[left]]
        return found


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series eight places on."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    below = np.log(np.prod([x + k for k in range(8)], axis=0))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - below


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many bits of each kind."""
    found = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)
    return np.where(zeros + ones > 0, found, 0.0)


class Level:
    """Nodes of contexts of one length: key (context and bit path), counts, log weight."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.key, self.zeros, self.ones, self.below = key, zeros, ones, below
        self.own = log_estimate(zeros, ones)
        self.weight = self.own if below is None else _HALF + np.logaddexp(self.own, below)
        self.ahead = (ones + 0.5) / (zeros + ones + 1.0)

    def stops(self) -> np.ndarray:
        """The share of the mixture that stops at the node."""
        return np.exp(_HALF + self.own - self.weight) if self.below is not None else np.ones(len(self.key))

    def shorter(self, length: int) -> tuple[Level, np.ndarray]:
        """The level of contexts of ``length`` bytes, and the place there of each node here."""
        mask = np.uint64((1 << 8 * length) - 1)
        key = (((self.key >> np.uint64(8)) & mask) << np.uint64(8)) | (self.key & np.uint64(255))
        key, at = np.unique(key, return_inverse=True)
        sums = [np.bincount(at, x, len(key)) for x in (self.zeros, self.ones, self.weight)]
        return Level(key, *sums), at


def _bits(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node keys and bits of grams, in eight rows."""
    byte, high = grams & np.uint64(255), (grams >> np.uint64(8)) << np.uint64(8)
    key, bit = [], []
    for i in range(8):
        key.append(high | np.uint64(1 << i) | (byte >> np.uint64(8 - i)))
        bit.append((byte >> np.uint64(7 - i)) & np.uint64(1))
    return np.array(key), np.array(bit).astype(float)


class Tree:
    """The levels from ``top`` + 1 to ``depth`` under some contexts of ``top`` bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        keys, self.bits = _bits(grams)
        key, at = np.unique(keys.ravel(), return_inverse=True)
        self.at = at.reshape(keys.shape)
        ones = np.bincount(at, (self.bits * counts).ravel(), len(key))
        zeros = np.bincount(at, ((1 - self.bits) * counts).ravel(), len(key))
        self.levels, self.up = [Level(key, zeros, ones, None)], []
        for length in range(depth - 1, top - 1, -1):
            level, at = self.levels[-1].shorter(length)
            self.levels.append(level)
            self.up.append(at)

    def scores(self, mass: np.ndarray, said: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram. ``mass`` and ``said``, for nodes of the top level, are the
        share of the mixture that goes below and what the levels so far give to a bit of 1."""
        for level, at in zip(self.levels[-2::-1], self.up[::-1]):
            mass, said = mass[at], said[at]
            stops = level.stops()
            said = said + mass * stops * level.ahead
            mass = mass * (1 - stops)
        ahead = said[self.at]
        return np.log10(np.where(self.bits > 0, ahead, 1 - ahead)).sum(axis=0)


def _trees(grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Trees over some whole contexts each, about ``BUNCH`` grams at a time, with their grams' places."""
    contexts = (grams >> np.uint64(8)) & np.uint64((1 << 8 * top) - 1)
    order = np.argsort(contexts, kind="stable")
    starts = np.flatnonzero(np.diff(contexts[order], prepend=contexts[order[:1]] + np.uint64(1)))
    begin = 0
    while begin < len(order):
        later = starts[np.searchsorted(starts, begin + BUNCH) :]
        end = int(later[0]) if len(later) else len(order)
        at = order[begin:end]
        yield Tree(grams[at], counts[at], depth, top), at
        begin = end


_NODE = ["ctx", "u", "zeros", "ones", "weight", "stops", "ahead"]
_NODES = "ctx bigint, u bigint, zeros double, ones double, weight double, stops double, ahead double"


def _weighed(level: DataFrame) -> DataFrame:
    """ctx, u, zeros, ones, weight, stops, ahead of nodes (ctx, u, zeros, ones, below)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctx, u, zeros, ones, below = (c.to_numpy() for c in batch.columns)
            of = Level(ctx, zeros, ones, below)
            columns = [ctx, u, zeros, ones, of.weight, of.stops(), of.ahead]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NODE)

    return level.select("ctx", "u", "zeros", "ones", "below").mapInArrow(run, _NODES)


def _asked_grams(found: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The grams of each row, and all distinct ones with their counts."""
    opened = [_opened(one) for one in found["asked"]]
    own = [one["key"].to_numpy() for one in opened]
    return own, *_summed(own, [one["n"].to_numpy() for one in opened])


def gram_answers(asked: DataFrame, depth: int, top: int, buckets: int) -> DataFrame:
    """block, is_gram, answer: log10 probabilities of the grams' bytes in their contexts.

    Grams that only texts have that aren't learned from count 0 and change nothing in the tree. One
    bottom-up pass weighs the nodes, one top-down pass gives each the mixture along its path.
    """

    def top_nodes(found: pa.Table) -> pa.Table:
        _, grams, counts = _asked_grams(found)
        columns: list[list[np.ndarray]] = [[] for _ in _NODE]
        for tree, _ in _trees(grams, counts, depth, top):
            level = tree.levels[-1]
            key = level.key.view(np.int64)
            node = (key >> 8, key & 255, level.zeros, level.ones, level.weight, level.stops(), level.ahead)
            for held, column in zip(columns, node):
                held.append(column)
        return pa.table([np.concatenate(c) for c in columns], _NODE)

    # Weighed where they are made: a second step in Python would give each task a second worker.
    levels = [stored(asked.select("bucket", "asked").groupBy("bucket").applyInArrow(top_nodes, _NODES), "nodes")]
    for length in range(top - 1, -1, -1):
        above = levels[-1].groupBy(F.expr(f"ctx & {(1 << 8 * length) - 1}L").alias("ctx"), "u")
        sums = above.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weight").alias("below"))
        levels.append(stored(_weighed(sums), "nodes"))
    paths = None
    for length, level in enumerate(reversed(levels)):
        mass, said, node = F.lit(1.0), F.lit(0.0), level.alias("n")
        if paths is not None:
            shorter = F.expr(f"n.ctx & {(1 << 8 * (length - 1)) - 1}L") == F.col("p.ctx")
            node = node.join(paths.alias("p"), shorter & (F.col("n.u") == F.col("p.u")))
            mass, said = F.col("p.mass"), F.col("p.said")
        paths = node.select(
            "n.ctx",
            "n.u",
            (mass * (1 - F.col("n.stops"))).alias("mass"),
            (said + mass * F.col("n.stops") * F.col("n.ahead")).alias("said"),
        )
    paths = paths.withColumn("bucket", F.expr(f"ctx % {buckets}L"))

    def walked(found: pa.Table, paths: pa.Table) -> pa.Table:
        own, grams, counts = _asked_grams(found)
        key = ((paths["ctx"].to_numpy() << 8) | paths["u"].to_numpy()).view(np.uint64)
        order = np.argsort(key)
        mass, said = paths["mass"].to_numpy(), paths["said"].to_numpy()
        scores = np.zeros(len(grams))
        for tree, at in _trees(grams, counts, depth, top):
            node = order[np.searchsorted(key[order], tree.levels[-1].key)]
            scores[at] = tree.scores(mass[node], said[node])
        answers = [_packed(["key", "value"], [pa.array(g), pa.array(scores[np.searchsorted(grams, g)])]) for g in own]
        return pa.table([found["block"], pa.array([True] * len(own)), pa.array(answers, pa.binary())], _ANSWER)

    mine = asked.select("bucket", "block", "asked").groupBy("bucket")
    return mine.cogroup(paths.groupBy("bucket")).applyInArrow(walked, "block bigint, is_gram boolean, answer binary")


_ANSWER = ["block", "is_gram", "answer"]


def _counted_words(found: pa.Table) -> tuple[list[pa.Array], pa.Table]:
    """The words of each row, and all distinct ones (key) with their counts (n_sum)."""
    opened = [_opened(one) for one in found["asked"]]
    both = pa.Table.from_batches(opened)
    return [one["key"] for one in opened], both.group_by("key").aggregate([("n", "sum")])


def word_totals(asked: DataFrame) -> tuple[int, int]:
    """Tokens learned from, and how many are distinct."""

    def sums(found: pa.Table) -> pa.Table:
        n = _counted_words(found)[1]["n_sum"].to_numpy()
        return pa.table([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], ["total", "kinds"])

    each = asked.select("bucket", "asked").groupBy("bucket").applyInArrow(sums, "total bigint, kinds bigint")
    return tuple(each.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first())


def word_answers(asked: DataFrame) -> DataFrame:
    """block, is_gram, answer: how often the words are learned from."""

    def run(found: pa.Table) -> pa.Table:
        own, counts = _counted_words(found)
        keys, n = counts["key"].combine_chunks(), counts["n_sum"].combine_chunks()
        answers = [_packed(["key", "value"], [k, n.take(pa.compute.index_in(k, keys))]) for k in own]
        return pa.table([found["block"], pa.array([False] * len(own)), pa.array(answers, pa.binary())], _ANSWER)

    mine = asked.select("bucket", "block", "asked").groupBy("bucket")
    return mine.applyInArrow(run, "block bigint, is_gram boolean, answer binary")


def scored(documents: DataFrame, learns: Column, depth: int = DEPTH, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are runs outside [\\x20\\x09-\\x0D], A-Z lower-cased, then one end; the bytes that are
    scored are each word with a space, then the end, so white space itself isn't. ``learns`` says
    which rows the counts come from. A null text counts as empty and has the end alone, a row where
    ``learns`` is null is learned from. Rows are scored one by one: repeated rows and null ids change
    nothing but the counts, further columns are ignored, an empty table gives an empty one. A long
    text is read in bounded pieces.
    """
    top = max(depth - BELOW, 0)
    buckets = BUCKETS * partitions(documents.sparkSession) + 1
    blocks = blocks_of(documents, learns, block_bytes)
    asked = stored(_asked(blocks, depth, top, buckets), "asked")
    words = asked.where("NOT is_gram")
    total, kinds = word_totals(words)
    answers = gram_answers(asked.where("is_gram"), depth, top, buckets).unionByName(word_answers(words))

    def add_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        grams_, scores, of = [], [], {}
        for is_gram, one in zip(found["is_gram"].to_pylist(), found["answer"]):
            batch = _opened(one)
            if is_gram:
                grams_.append(batch["key"].to_numpy())
                scores.append(batch["value"].to_numpy())
            else:
                of.update(zip(batch["key"].to_pylist(), batch["value"].to_pylist()))
        table, value = GramTable(np.concatenate(grams_)), np.concatenate(scores)
        grams_.clear(), scores.clear()
        bottom = np.log10(total + 0.5 * (kinds + 1))
        made: list[tuple] = []
        sums: list[np.ndarray] = []
        grams = Grams(depth)

        def flush() -> None:
            wanted, owners = grams.taken()
            sums.append(np.bincount(owners, value[table.places(wanted)]))

        def read(words: list[bytes]) -> tuple[int, int, float]:
            c = np.fromiter(map(of.__getitem__, words), float, len(words))
            return len(c), int(np.count_nonzero(c)), float(np.sum(np.log10(c + 0.5) - bottom))

        for i, (doc_id, learns, text) in enumerate(_unpacked(texts["texts"])):
            grams.start()
            counts = read([END])
            for words in word_lists(text):
                if words:
                    counts = tuple(a + b for a, b in zip(counts, read(words)))
                    grams.add(i, b" ".join(words) + b" ")
                if grams.size > PIECE:
                    flush()
            grams.add(i, END)
            made.append((doc_id, learns, *counts))
        flush()
        score = np.zeros(len(made))
        for one in sums:
            score[: len(one)] += one
        doc_id, learned, tokens, known, base = zip(*made)
        columns = [pa.array(doc_id, pa.int64()), pa.array(learned, pa.bool_()), pa.array(tokens), pa.array(known)]
        columns += [pa.array([total] * len(made)), pa.array(base), pa.array(score)]
        return pa.table(columns, names)

    names = ["doc_id", "learns", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = (
        "doc_id bigint, learns boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)


def learned_from(doc_id: str = "doc_id") -> Column:
    """Whether a row is learned from: crc32 of its id as text, mod 5, isn't 1. A null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 1, F.lit(True))


@query("op13_lm_scoring")
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), learned_from())
    return found.select(
        "doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
