"""Window and byte-string dedup against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cohortspan.llm import substring_dedup as windows
from cohortspan.llm import suffix_dedup as strings

from tests.llm import odd


def more_rows():
    rng = random.Random(4)
    hot = " ".join(f"h{i}" for i in range(60))
    noise = lambda n: " ".join(f"n{rng.randrange(5000)}" for _ in range(n))
    rows = odd.texts() + [(100 + i, f"{noise(30)} {hot} {noise(30)}") for i in range(12)]
    # runs that no trigger cuts, and a period
    return rows + [(200, "ab" * 900), (201, "a" * 650), (202, "xyz " * 300), (203, noise(200) * 2)]


@pytest.mark.parametrize("part", [4096, 2])
def test_windows(spark, part):
    rows = more_rows()
    docs = odd.documents(spark, rows)
    runs = windows.repeated_runs(docs, part=part)
    out = windows.without_runs(docs, runs).collect()
    expected = [(i, *r) for (i, _), r in zip(rows, odd.without_windows(rows, 20))]
    assert odd.by_text((r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == odd.by_text(expected)


@pytest.mark.parametrize("part", [4096, 2])
def test_byte_strings(spark, part):
    rows = more_rows()
    docs = odd.documents(spark, rows)
    kept = strings.without_strings(docs, strings.repeated_starts(docs, part=part))
    out = kept.withColumn("sha", F.sha2("kept", 256)).collect()
    expected = [(i, *r) for (i, _), r in zip(rows, odd.without_strings(rows, 400))]
    got = odd.by_text((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in out)
    assert got == odd.by_text(expected)


def test_classes_are_those_of_the_strings():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(80)) for _ in range(6)]
    places, length = [], 70
    for n, text in enumerate([*texts, texts[0][5:] + "bbbbb"]):
        before = rng.randrange(10, 16)
        places.append(strings.Place(False, str(n), 0, [0], before, text.encode()))
    for offset, has, classes in strings.string_classes(places, length):
        found = [places[i].packed[places[i].before - offset :][:length] for i in has]
        for a in range(len(has)):
            for b in range(a):
                assert (classes[a] == classes[b]) == (found[a] == found[b])


def test_empty_tables(spark):
    none = odd.documents(spark, [])
    assert windows.substring_dedup(none).collect() == []
    assert strings.suffix_dedup(none).collect() == []


def test_passages_below_and_above_the_length(spark):
    """Planted passages of over 50 words: those of 400 bytes and more go, shorter ones stay, a hot one
    in every fourth document included; the rest is left alone."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passages = {"short": [" ".join(word(5) for _ in range(52)) for _ in range(4)]}
    passages["long"] = [" ".join(word(8) for _ in range(52)) for _ in range(4)]
    passages["hot"] = [" ".join(word(9) for _ in range(55))]
    assert all(len(p) < 400 for p in passages["short"]) and all(len(p) > 400 for p in passages["long"])
    rows, held = [], {}
    for i in range(160):
        kind = ["hot", "short", "long", None][i % 4]
        held[i] = kind
        body = [" ".join(word(7) for _ in range(60)) for _ in range(2)]
        rows.append((i, f" {rng.choice(passages[kind]) if kind else word(300)} ".join(body)))
    out = {r.doc_id: r for r in strings.suffix_dedup(odd.documents(spark, rows)).collect()}
    for (i, _), expected in zip(rows, odd.without_strings(rows, 400)):
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans) == expected[:3]
        assert (out[i].n_removed > 0) == (held[i] in ("long", "hot"))
