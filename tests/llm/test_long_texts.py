"""Texts of 5 MB, with and without white space, at default settings, against plain Python."""

import random

import pytest

from cohortspan.llm import decontamination, line_dedup, minhash_dedup, quality_rules

from tests.llm import odd


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(7)
    spaced = [f"w{rng.randrange(100_000)}" for _ in range(700_000)]
    for at in range(40, len(spaced), 40):
        spaced[at] += "\n"
    item = odd.sentence(5, 30)
    text = " ".join(spaced) + "\n" + item
    assert len(text) > 4_500_000
    return [(1, text), (2, "é" * 2_500_000), (3, text + " end"), (4, item), (5, "a" * 5_000_000), (6, "a" * 5_000_000)]


def test_near_duplicates_of_long_texts(spark, long_rows):
    out = minhash_dedup.near_duplicates(odd.documents(spark, long_rows), 85).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    component = {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}
    assert got == {i: (len(odd.shingles(t)), component[i]) for i, t in long_rows}


def test_measures_of_long_texts(spark, long_rows):
    out = quality_rules.measured_verdicts(odd.documents(spark, long_rows)).collect()
    got = {r.doc_id: (*[r[n] for n in quality_rules.MEASURES], r.kept) for r in out}
    assert got == {i: (*odd.measures(t), odd.passes(t)) for i, t in long_rows}


def test_lines_of_long_texts(spark, long_rows):
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(odd.documents(spark, long_rows)).collect()}
    assert out == {i: "\n".join(kept) for (i, _), (_, kept) in zip(long_rows, odd.kept_lines(long_rows))}


def test_items_in_long_texts(spark, long_rows):
    items = [(1, odd.sentence(5, 30)), (2, "a" * 5_000_000)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontamination.contained_items(odd.documents(spark, long_rows), table).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 1), (3, 1), (4, 1), (5, 2), (6, 2)}
