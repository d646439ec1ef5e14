"""Phrase collocations by best-first branch-and-bound growth.

A phrase is grown word by word from its prefix. With ``c`` occurrences of a prefix and ``f`` of its
first word, no phrase that begins with the prefix scores above ``2000000 c / (f + c)``: a phrase is at
most as frequent as its prefix, and the cut behind its first word has ``f`` on the left and at least
the phrase's own count on the right. Prefixes are expanded in order of that bound, in one pass over
the texts for all of a bound level; a language is settled when enough phrases survive that score
above the level, since everything not expanded scores below it. A phrase's extensions by one word to
either side, which its expansion counts, decide whether it survives.

Phrases are counted as text. Filters of a fixed size choose what a pass counts: they may let more
through, never less, and whatever is counted is counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspan.llm.bloom import HashFilter
from cohortspan.llm.common import slices, split_join, stored, table
from cohortspan.llm.registry import query
from cohortspan.llm.shingles import windows_of

#: Occurrences of a candidate, its most words, the share (percent) at which a longer one replaces it.
LEAST, LONGEST, SHARE = 30, 4, 80
#: Phrases reported for each language.
TOP = 2000
#: Bits of the filters of frequent pairs and of expanded phrases.
FREQUENT_BITS, EXPANDED_BITS = 1 << 26, 1 << 23
#: Words that a task holds at once, of all languages.
HELD = 1 << 20
#: Bound levels are multiples of this; the first one has so many pairs at or above it for each phrase
#: that is asked for, later ones four times as many as the one before.
STEP, FIRST = 1000, 2
_SALTS = 64

#: What ends a piece, as "." (which is one of them), and what separates words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(_ENDS)
)
_BREAK = re.compile(rb"[ .]")


class _Places(dict):
    """Number of a word, in order of first appearance; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Held:
    """Words of one language that a task has read: numbers, and a hash for each number."""

    def __init__(self, lang: str, before: list[bytes] = ()) -> None:
        self.lang, self.places = lang, _Places({b".": 0})
        #: words before the first new one, which phrases may begin in
        self.before = len(before)
        self.parts = [self._numbers(list(before))]
        self.size = 0

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, words), np.int32, len(words))

    def add(self, words: list[bytes]) -> None:
        self.parts.append(self._numbers(words))
        self.size += len(words)

    def seal(self) -> None:
        self.words = list(self.places)
        self.ids = np.concatenate(self.parts)
        seed = self.lang.encode() + b"\0"
        own = np.fromiter((xxhash.xxh3_64_intdigest(seed + w) for w in self.words), np.uint64, len(self.words))
        self.hashes = own[self.ids]

    def tail(self) -> list[bytes]:
        return [self.words[i] for i in self.ids[-(LONGEST - 1) :]]

    def starts(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words begin that end in a new word and cross no piece."""
        count = max(len(self.ids) - size + 1, 0)
        whole = np.arange(count) + size > self.before
        for k in range(size):
            whole &= self.ids[k : k + count] > 0
        return whole

    def counted(self, size: int, chosen: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases at the chosen places, and how often each is there."""
        at = np.flatnonzero(chosen)
        code = self.ids[at].astype(np.int64)
        for k in range(1, size):
            _, code = np.unique(code, return_inverse=True)
            code = code * len(self.words) + self.ids[at + k]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        words = pa.array(self.words, pa.binary())
        parts = [words.take(pa.array(self.ids[at[first] + k])) for k in range(size)]
        return (pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]).cast(pa.string()), n


def word_lists(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text with "." where a piece ends, a bounded part of the text at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    begin = 0
    while begin < len(data):
        cut = _BREAK.search(data, begin + size) if begin + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[begin:end].replace(b".", b" . ").split()
        begin = end
    yield [b"."]


Count = Callable[[Held], Iterator[tuple[int, pa.Array, np.ndarray]]]


def _pass(documents: DataFrame, count: Count, held_words: int) -> DataFrame:
    """lang, phrase, size, h, n: what ``count`` makes of the words that tasks hold at once."""

    def rows(held: Held) -> Iterator[pa.RecordBatch]:
        held.seal()
        for size, found, n in count(held):
            for a in range(0, len(n), 1 << 17):
                part = found[a : a + (1 << 17)]
                if size:
                    phrase, h = part, pa.nulls(len(part), pa.int64())
                else:
                    phrase, h = pa.nulls(len(part), pa.string()), pa.array(part.view(np.int64))
                lang = pa.array([held.lang]).take(pa.array(np.zeros(len(part), np.int32)))
                columns = [lang, phrase, pa.array(np.full(len(part), size, np.int32)), h]
                columns.append(pa.array(n[a : a + (1 << 17)].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Held] = {}
        total = 0
        for part in slices(batches):
            for lang, text in zip(*(c.to_pylist() for c in part.columns)):
                for words in word_lists(text):
                    if lang not in open_:
                        open_[lang] = Held(lang)
                    open_[lang].add(words)
                    total += len(words)
                    if total >= held_words:
                        full = max(open_.values(), key=lambda held: held.size)
                        yield from rows(full)
                        total -= full.size
                        open_[full.lang] = Held(full.lang, full.tail())
        for held in open_.values():
            yield from rows(held)

    texts = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    )
    return texts.mapInArrow(run, "lang string, phrase string, size int, h bigint, n bigint")


def _summed(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size, f of phrases found ``least`` times or more."""
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _hashed(phrases: DataFrame) -> DataFrame:
    """The hash that ``Held`` gives each (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                seed, words = lang.encode() + b"\0", phrase.encode().split(b" ")
                of = np.fromiter((xxhash.xxh3_64_intdigest(seed + w) for w in words), np.uint64, len(words))
                made.append(windows_of(of, len(words)))
            h = np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h bigint")


def _of(expression: str) -> Column:
    return F.expr(expression)


#: Words of a phrase, and its parts as text.
_WORDS = "split(phrase, ' ')"
_FIRST_WORD = "substring_index(phrase, ' ', 1)"
_WITHOUT_FIRST = "substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"
_WITHOUT_LAST = "array_join(slice(split(phrase, ' '), 1, size - 1), ' ')"


def _ratio(a: str, below: str) -> Column:
    """floor(2000000 a / below) in exact arithmetic."""
    return F.expr(f"(CAST({a} AS DECIMAL(20, 0)) * 2000000) DIV ({below})").cast("long")


def _bounded(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, size, f, bound: what nothing that begins with the phrase scores above."""
    firsts = words.select("lang", F.col("phrase").alias("first"), F.col("f").alias("first_f"))
    rows = split_join(phrases.withColumn("first", _of(_FIRST_WORD)), firsts, ["lang", "first"])
    below = "CAST(first_f AS DECIMAL(20, 0)) + f"
    return rows.select("lang", "phrase", "size", "f", _ratio("f", below).alias("bound"))


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, size, f, l, r, score: by the lowest-scoring cut, of ties the first."""
    cuts = phrases.select("lang", "phrase", "size", "f", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns(
        {
            "left": _of(f"array_join(slice({_WORDS}, 1, k), ' ')"),
            "right": _of(f"array_join(slice({_WORDS}, k + 1, size - k), ' ')"),
        }
    )
    for side, name in (("left", "l"), ("right", "r")):
        of = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = split_join(cuts, of, ["lang", side])
    below = "CAST(l AS DECIMAL(20, 0)) + r"
    cut = F.struct(_ratio("f", below).alias("score"), "k", "l", "r")
    best = cuts.groupBy("lang", "phrase", "size", "f").agg(F.min(cut).alias("cut"))
    return best.select("lang", "phrase", "size", "f", "cut.l", "cut.r", "cut.score")


def _surviving(scored: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """Candidates that no candidate one word longer covers to ``share`` percent. (Nor does a longer
    one then: a phrase between the two is at least as frequent.)"""
    inner = longer.select("lang", F.explode(F.array(_of(_WITHOUT_FIRST), _of(_WITHOUT_LAST))).alias("phrase"), "f")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    return joined.where(f"most IS NULL OR 100 * most < {share} * f").drop("most")


def _levels(nodes: DataFrame, wanted: int, value: str) -> DataFrame:
    """lang, level: the highest multiple of STEP with ``wanted`` nodes at or above it, else 0."""
    bins = nodes.groupBy("lang", F.expr(f"{value} DIV {STEP}").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("bin"))
    reached = bins.withColumn("upto", F.sum("n").over(above)).groupBy("lang")
    enough = F.when(F.col("upto") >= wanted, F.col("bin") * STEP)
    return reached.agg(F.coalesce(F.max(enough), F.lit(0)).alias("level"))


def _within(nodes: DataFrame, levels: DataFrame, value: str) -> DataFrame:
    """Nodes at or above their language's level and below the one before."""
    return nodes.join(levels, "lang").where(f"{value} >= level AND {value} < before").drop("level", "before")


def collocations(
    documents: DataFrame,
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
    first: int = FIRST,
    held_words: int = HELD,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    A null language counts as ``und``, a null text as empty; repeated rows count each, other columns
    are ignored, and an empty table gives an empty one. A long text is read in bounded pieces, and a
    task holds ``held_words`` words at once. Ties in score go to the more frequent
    phrase, then to the smaller one in byte order.
    """
    counts = _first_counts(documents, least, held_words)
    per_lang = counts.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    words = counts.where(f"size = 1 AND f >= {least}").select("lang", "phrase", "size", "f")
    frequent = HashFilter(counts.where("size = 0").select("h"), FREQUENT_BITS)

    def pairs_only(held: Held):
        yield 2, *held.counted(2, held.starts(2) & frequent(windows_of(held.hashes, 2)))

    pairs = stored(_bounded(_summed(_pass(documents, pairs_only, held_words), least), words), "pairs")
    pair_scores = stored(_scored(pairs, words), "pair-scores")
    wanted, round_ = first * top, 0
    levels = _levels(pair_scores, wanted, "score").withColumn("before", F.lit(1 << 40))
    levels = stored(levels, "levels")
    triples = quads = pairs.limit(0).drop("bound")
    while True:
        chosen = _within(pairs, levels, "bound")
        expanded = HashFilter(_hashed(chosen), EXPANDED_BITS)

        def triples_of(held: Held, expanded=expanded):
            of = windows_of(held.hashes, 2)
            known, grown = frequent(of), expanded(of)
            yield 3, *held.counted(3, held.starts(3) & known[:-1] & known[1:] & (grown[:-1] | grown[1:]))

        found = _summed(_pass(documents, triples_of, held_words), least)
        triples = stored(triples.unionByName(found).distinct(), "triples")
        bounded = stored(_bounded(triples, words), "triple-bounds")
        grown = HashFilter(_hashed(_within(bounded, levels, "bound")), EXPANDED_BITS)

        def quads_of(held: Held, grown=grown):
            known, of = frequent(windows_of(held.hashes, 2)), grown(windows_of(held.hashes, 3))
            chosen = held.starts(4) & known[:-2] & known[1:-1] & known[2:] & (of[:-1] | of[1:])
            yield 4, *held.counted(4, chosen)

        found = _summed(_pass(documents, quads_of, held_words), least)
        quads = stored(quads.unionByName(found).distinct(), "quads")
        # a phrase of four words is scored by its last three, too, which may lie in nothing expanded
        reached = levels.select("lang", "level")
        good = _bounded(quads, words).join(reached, "lang").where("bound >= level").drop("level", "bound")
        ends = good.select("lang", _of(_WITHOUT_FIRST).alias("phrase")).distinct()
        ends = stored(ends.join(triples, ["lang", "phrase"], "left_anti"), "ends")
        if not ends.isEmpty():
            asked = HashFilter(_hashed(ends), EXPANDED_BITS)

            def ends_of(held: Held, asked=asked):
                yield 3, *held.counted(3, held.starts(3) & asked(windows_of(held.hashes, 3)))

            found = _summed(_pass(documents, ends_of, held_words), least)
            triples = stored(triples.unionByName(found).distinct(), "triples")
        known = words.unionByName(pairs.drop("bound")).unionByName(triples)
        open_ = bounded.join(reached, "lang").where("bound >= level").drop("level", "bound")
        scored = pair_scores.unionByName(_scored(open_.unionByName(good), known))
        scored = scored.join(reached, "lang").where("score >= level").drop("level")
        kept = stored(_surviving(scored, triples.unionByName(quads), share), "settled")
        enough = levels.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left")
        short = enough.where(f"level > 0 AND coalesce(kept, 0) < {top}").select("lang", "level")
        if short.isEmpty():
            break
        wanted, round_ = 4 * wanted, round_ + 1
        # settled languages have an empty range from now on
        below = _levels(pairs, wanted, "bound").withColumnRenamed("level", "low")
        next_ = levels.join(short.select("lang", F.lit(True).alias("short")), "lang", "left").join(below, "lang", "left")
        lower = F.when(F.col("short") & (F.col("low") < F.col("level")), F.col("low")).when(F.col("short"), 0)
        levels = stored(
            next_.select("lang", F.coalesce(lower, "level").cast("long").alias("level"), F.col("level").alias("before")),
            "levels",
        )
    by = [F.desc("score"), F.desc("f"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    some = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*by)))
    some = some.where(f"place <= {top}")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)))
    rows = ranked.where(f"rank <= {top}").join(per_lang, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _first_counts(documents: DataFrame, least: int, held_words: int) -> DataFrame:
    """All words with their counts (size 1), and hashes of pairs found ``least`` times or more (size 0)."""

    def count(held: Held):
        yield 1, *held.counted(1, held.starts(1))
        found, n = np.unique(windows_of(held.hashes, 2)[held.starts(2)], return_counts=True)
        yield 0, found, n

    sums = _pass(documents, count, held_words).groupBy("lang", "phrase", "size", "h").agg(F.sum("n").alias("f"))
    return stored(sums.where(f"size = 1 OR f >= {least}"), "first-counts")


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS m))
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.m, c.w, c.f AS a, k, x.f AS l, y.f AS r,
    CAST(CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates)) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE most IS NULL OR 100 * most < 80 * a
) JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
