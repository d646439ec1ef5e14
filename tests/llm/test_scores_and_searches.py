"""Lexical search, collocations and language-model scores against plain Python."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortspan.llm import lm_scoring
from cohortspan.llm.collocations import collocations
from cohortspan.llm.lexical_search import Lists, nearest, search
from cohortspan.llm.lm_scoring import learned_from, log_estimate, scored
from tests.llm import odd

ITEMS = [
    (1, odd.sentence(1)),
    (2, "This LINE stands, in many documents"),
    (3, None),
    (4, "nothing-here zzz"),
    (5, "it's again é w1 w2 w3"),
    (5, "w7 w7 w14"),
    (5, "w7 w7 w14"),
    (None, "word"),
]


def terms(text):
    folded = odd.fold(text)
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def ranked(rows, items, k):
    """(item_id, rank, doc_id, score) of every item text."""
    counts = [(i, collections.Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    made = []
    for item, text in set(items):
        found = []
        for i, c in counts:
            m = 50 + (50 * c.total() * total) // length
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is not None, i or 0))
        for rank, (score, known, i) in enumerate(sorted(found)[:k], 1):
            made.append((item, rank, i if known else None, -score))
    return made


def item_frame(spark, items):
    return spark.createDataFrame(
        [(i, t, 1, "r") for i, t in items], "item_id bigint, text string, rank int, row string"
    )


@pytest.mark.parametrize("k, block_terms, shard_counts", [(3, 500_000, 2_000_000), (50, 20, 30)])
def test_search(spark, k, block_terms, shard_counts):
    rows = odd.texts() + [(100 + i, odd.sentence(i % 7, 30 + i % 3)) for i in range(60)]
    docs = odd.documents(spark, rows).repartition(3, "doc_id")
    found = search(docs, item_frame(spark, ITEMS), k, block_terms, shard_counts)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert odd.by_text(tuple(r) for r in found.collect()) == odd.by_text(ranked(rows, ITEMS, k))


def test_search_of_nothing(spark):
    none, some = odd.documents(spark, []), odd.documents(spark)
    assert search(none, item_frame(spark, ITEMS)).isEmpty()
    assert search(some, item_frame(spark, [])).isEmpty()
    assert search(odd.documents(spark, [(1, None), (2, " .")]), item_frame(spark, ITEMS)).isEmpty()


def test_lists_are_not_read_to_the_end_where_the_best_stand_out():
    """Rare words decide; the long list of a common one is left once nothing in it can matter."""
    rng = random.Random(3)
    count = 50_000
    common = sorted(rng.sample(range(count), 40_000))
    rare = rng.sample(common, 60)
    np = pytest.importorskip("numpy")
    docs = np.array([*common, *rare, *rare])
    kinds = np.repeat([0, 1, 2], [len(common), 60, 60])
    units = np.array([rng.randrange(1, 300_000) for _ in common] + [rng.randrange(500_000, 900_000) for _ in range(120)])
    units[: len(common)] = np.sort(units[: len(common)])[::-1]
    lists = Lists.of(kinds, docs, units, 3, count)
    weights = np.array([1, 9000, 9000])
    scores, read = nearest(lists, np.arange(3), weights, 10)
    full = np.zeros(count, np.int64)
    np.add.at(full, docs, weights[kinds] * units)
    best = np.argsort(-full, kind="stable")[:10]
    assert (scores[best] == full[best]).all() and (np.argsort(-scores, kind="stable")[:10] == best).all()
    assert ((scores == 0) | (scores == full) | (scores < full[best[-1]])).all()
    assert read <= len(docs)


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", odd.fold(text)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def mined(rows, least, share, top):
    found = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for w in pieces(text or ""):
            for m in range(1, 5):
                found[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    made = []
    for lang, f in found.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            inside = any(
                len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            )
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            made.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return made


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["New", "york", "city", "hall", "of", "the", "é", "a b", "x\ty", "big", "red", "dog."]
    rows = []
    for i in range(260):
        words = rng.choices(vocabulary, [5, 5, 4, 3, 9, 9, 2, 2, 2, 1, 1, 3], k=40)
        if i % 3 == 0:
            words[5:9] = ["new", "york", "city", "hall"]
        rows.append((rng.choice(["en", "en", "fr", None]), " ".join(words)))
    return [*rows, ("en", None), ("fr", ""), ("de", "only once, here"), ("en", " .!? \n\x0b")]


@pytest.mark.parametrize("least, top, first, held", [(30, 2000, 2, 1 << 20), (5, 6, 1, 700), (3, 25, 1, 900)])
def test_collocations(spark, least, top, first, held):
    """Few phrases asked for make several rounds; few words held cut texts into parts."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "lang string, text string, size int, phrase string")
    found = collocations(docs.repartition(3), least, 80, top, first, held).collect()
    assert odd.by_text(tuple(r) for r in found) == odd.by_text(mined(rows, least, 80, top))


def test_collocations_of_nothing(spark):
    assert collocations(odd.documents(spark, [])).isEmpty()
    assert collocations(odd.documents(spark, [(1, None), (2, "a b")])).isEmpty()


class PlainTree:
    """The weighted tree by definition: recursion over contexts, one bit path at a time."""

    def __init__(self, texts, depth):
        self.depth, self.bits = depth, collections.defaultdict(lambda: [0, 0])
        for text in texts:
            for context, byte in self.grams(text):
                for d in range(depth + 1):
                    for u, bit in self.path(byte):
                        self.bits[context[depth - d :], u][bit] += 1

    def grams(self, text):
        data = b"\n" * self.depth + b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n"
        return [(data[i - self.depth : i], data[i]) for i in range(self.depth, len(data))]

    def path(self, byte):
        return [((1 << i) | (byte >> (8 - i)), byte >> (7 - i) & 1) for i in range(8)]

    def estimate(self, s, u):
        a, b = self.bits.get((s, u), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighed(self, s, u):
        own = self.estimate(s, u)
        if len(s) == self.depth:
            return own
        longer = {t for t, v in self.bits if v == u and len(t) == len(s) + 1 and t.endswith(s)}
        below = sum(self.weighed(t, u) for t in longer)
        return math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))

    def ahead(self, context, u, d=0):
        s = context[self.depth - d :]
        a, b = self.bits.get((s, u), (0, 0))
        if d == self.depth:
            return (b + 0.5) / (a + b + 1)
        stops = math.exp(math.log(0.5) + self.estimate(s, u) - self.weighed(s, u))
        return stops * (b + 0.5) / (a + b + 1) + (1 - stops) * self.ahead(context, u, d + 1)

    def score(self, text):
        total = 0.0
        for context, byte in self.grams(text):
            for u, bit in self.path(byte):
                p = self.ahead(context, u)
                total += math.log10(p if bit else 1 - p)
        return total


def test_estimate():
    np = pytest.importorskip("numpy")
    zeros, ones = np.array([0.0, 1, 5, 0, 1000, 10**9]), np.array([0.0, 0, 2, 70, 3, 10**7])
    expected = [
        math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        for a, b in zip(zeros, ones)
    ]
    assert log_estimate(zeros, ones) == pytest.approx(expected, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_scores_are_those_of_the_tree(spark, depth):
    rows = [(1, "Ab ab  aba\tb"), (2, "abba Ab"), (3, None), (4, "é a"), (5, "ab ab"), (None, "aab"), (5, "ab ab")]
    learns = {1, 2, None, 5}
    docs = odd.documents(spark, rows)
    found = scored(docs, F.coalesce(F.col("doc_id").isin(1, 2, 5), F.lit(True)), depth, block_bytes=12).collect()
    tree = PlainTree([t for i, t in rows if i in learns], depth)
    count = collections.Counter(w for i, t in rows if i in learns for w in [*odd.fold(t).split(), "\n"])
    total, kinds = count.total(), len(count)
    expected = []
    for i, t in rows:
        words = [*odd.fold(t).split(), "\n"]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        known = sum(count[w] > 0 for w in words)
        expected.append((i, i in learns, len(words), known, total, base, tree.score(t)))
    for got, wanted in zip(odd.by_text(tuple(r) for r in found), odd.by_text(expected)):
        assert got[:5] == wanted[:5]
        assert got[5:] == pytest.approx(wanted[5:], abs=1e-6)
    assert len(found) == len(expected)


def test_scores_of_odd_documents(spark):
    """Clashing columns and small blocks change nothing; nothing learned from gives even odds."""
    docs = odd.documents(spark)
    one = scored(docs, learned_from()).collect()
    many = scored(docs.repartition(3), learned_from(), block_bytes=500).collect()
    key = lambda r: str(tuple(r)[:6])
    for a, b in zip(sorted(one, key=key), sorted(many, key=key)):
        assert tuple(a)[:5] == tuple(b)[:5] and tuple(a)[5:] == pytest.approx(tuple(b)[5:], abs=1e-6)
    for r, (i, _) in zip(one, odd.texts()):
        assert r["learns"] == (zlib.crc32(str("" if i is None else i).encode()) % 5 != 1)
    assert scored(odd.documents(spark, []), learned_from()).isEmpty()
    even = scored(odd.documents(spark, [(1, "a b")]), F.lit(False)).first()
    assert even["train_tokens"] == 0 and even["score"] == pytest.approx(-5 * 8 * math.log10(2))
    assert even["base_score"] == 0


def test_held_out_texts_are_predicted_better_than_by_even_odds(spark):
    rows = [(i, odd.sentence(i % 40, 60)) for i in range(200)]
    found = scored(odd.documents(spark, rows), learned_from()).where("NOT learns").collect()
    assert found
    for r in found:
        text = odd.sentence(r["doc_id"] % 40, 60)
        assert -r["score"] / (len(text) + 2) < 0.35 * 8 * math.log10(2)


def test_no_task_of_the_tree_needs_two_python_workers(spark, monkeypatch):
    plans, write = [], lm_scoring.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(lm_scoring, "stored", seen)
    scored(odd.documents(spark, [(1, "a b a"), (2, "b c")]), learned_from())
    assert any("FlatMapGroupsInArrow" in plan for plan in plans)
    assert all(len(re.findall(r"(?:MapInArrow|InArrow) ", plan)) <= 1 for plan in plans)
