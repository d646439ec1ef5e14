"""Near-dedup, components and decontamination against plain Python."""

import itertools

import numpy as np
import pytest

from cohortspan.llm import minhash_dedup as near
from cohortspan.llm.components import connected_components
from cohortspan.llm.decontamination import contained_items, coordinates, decontaminate
from cohortspan.llm.shingles import shingle_set, words_of

from tests.llm import odd


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = odd.texts()
    out = near.near_duplicates(odd.documents(spark), percent).collect()
    found = odd.components(rows, percent)
    expected = [(i, len(odd.shingles(t)), found.get(i), i is None or found[i] == i) for i, t in rows]
    assert odd.by_text((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == odd.by_text(expected)


def edited(rng, base: list[str], edits: int) -> str:
    made = list(base)
    for at in rng.choice(len(base), edits, replace=False):
        made[at] = f"e{rng.integers(0, 6)}"
    return " ".join(made)


def test_hot_group_in_several_parts(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(int(i), edited(rng, base, int(rng.integers(0, 6)))) for i in rng.permutation(160)]
    out = near.near_duplicates(odd.documents(spark, rows), 85, part=16).collect()
    found = odd.components(rows, 85)
    assert {r.doc_id: r.component_id for r in out} == found
    assert len(set(found.values())) > 1


def test_links_between_what_pivots_leave_apart(spark):
    """Copies whose edits add up: a copy is like the next ones only, so a bucket has several trees."""
    base = [f"b{i}" for i in range(150)]
    rows = [(500 - i, " ".join([f"e{k}" if k < i else base[k] for k in range(150)])) for i in range(1, 90)]
    rows += [(i, " ".join(base[:149] + [f"tail{i}"])) for i in range(60)]
    found = odd.components(rows, 85)
    out = near.near_duplicates(odd.documents(spark, rows), 85, part=4).collect()
    assert {r.doc_id: r.component_id for r in out} == found


def classes_of(spark, n):
    """One bucket of n, and one of n that holds a band of its own for each tenth."""
    rows = [(i, [7, 1000 + i % 10]) for i in range(n)]
    return spark.createDataFrame(rows, "rep bigint, bands array<bigint>")


def test_units_grow_with_the_bucket(spark):
    sizes = {}
    for n in (2_000, 8_000):
        members = near.bucket_members(classes_of(spark, n), part=20).cache()
        first = near.first_units(members)
        star = spark.createDataFrame([(i, 0) for i in range(n - 15)], "node bigint, component bigint")
        later = near.later_units(members, star, part=20)
        sizes[n] = first.count(), later.count()
        largest = first.groupBy("unit").count().agg({"count": "max"}).first()[0]
        assert largest < 20 * 3
        members.unpersist()
    for few, many in zip(sizes[2_000], sizes[8_000]):
        assert many < 4.5 * few
    assert sizes[8_000][0] < 2 * 8_000 * (1 + 2 * near.PIVOTS / 20)


def test_every_open_pair_meets_in_a_later_unit(spark):
    members = near.bucket_members(classes_of(spark, 120), part=8)
    label = {i: (0 if i < 70 else 70 if i < 90 else i) for i in range(120)}
    tree = spark.createDataFrame(list(label.items()), "node bigint, component bigint")
    units = {}
    for r in near.later_units(members, tree, part=8).collect():
        units.setdefault(r.unit, set()).add(r.doc_id)
    met = {frozenset(p) for u in units.values() for p in itertools.combinations(sorted(u), 2)}
    assert all(frozenset((a, b)) in met for a in range(120) for b in range(a) if label[a] != label[b])


def test_a_row_repeated_many_times_is_one_set(spark):
    rows = [(1, odd.sentence(1))] * 3_000 + [(2, odd.sentence(1) + " more"), (1, odd.sentence(1))]
    docs = odd.documents(spark, rows)
    wanted = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    assert sorted(r.doc_id for r in near.shingle_table(docs, wanted).collect()) == [1, 2]
    out = near.near_duplicates(docs).collect()
    assert len(out) == len(rows) and {r.component_id for r in out} == {1}


def test_near_dedup_keeps_the_first(spark):
    docs = odd.documents(spark)
    out = near.near_dedup(docs)
    assert out.columns == docs.columns
    found = odd.components(odd.texts(), 80)
    expected = [(i, t) for i, t in odd.texts() if i is None or found[i] == i]
    assert odd.by_text((r.doc_id, r.text) for r in out.collect()) == odd.by_text(expected)


def test_linking_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        own[rng.choice(60, 6, replace=False)] = rng.integers(0, 40, 6).astype(np.uint64)
        sets.append(np.unique(own))
    ids = rng.permutation(120) * 2
    up = {int(i): int(i) for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(120):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                p, q = root(int(ids[a])), root(int(ids[b]))
                up[max(p, q)] = min(p, q)
    tree = {int(i): int(i) for i in ids} | {b: a for a, b in near.linked(ids, sets, 85)}
    assert all(tree[i] == root(i) for i in tree)


def test_circulant_signature_estimates_similarity():
    one = shingle_set([f"x{i}".encode() for i in range(400)])
    two = shingle_set([f"x{i}".encode() for i in range(40, 440)])
    true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    same = near.signature(one, 1024) == near.signature(two, 1024)
    assert abs(same.mean() - true) < 0.06


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 3), (200, 200)]
    out = connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in out} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def benchmark():
    return [
        (1, odd.sentence(41)),
        (2, odd.sentence(99, 8)),
        (3, "one TWO"),
        (4, ""),
        (5, None),
        (None, odd.sentence(81, 20)),
        (6, odd.sentence(1, 34) + " other words than these are here"),
        (7, "é" * 30),
        (1, odd.sentence(41)),
    ]


def test_contained_items(spark):
    items = spark.createDataFrame(benchmark(), "item_id bigint, text string")
    docs = odd.documents(spark)
    out = contained_items(docs, items)
    expected = odd.contained(odd.texts(), benchmark())
    assert len(expected) > 8
    got = [(r.doc_id, r.item_id, r.n_item_shingles, r.n_common) for r in out.collect()]
    assert odd.by_text(got) == odd.by_text(expected)
    clean = decontaminate(docs, items)
    assert clean.columns == docs.columns
    texts = {i: t for i, t in odd.texts()}
    leaked = {(i, texts[i]) for i, *_ in expected if i is not None} | {(None, odd.sentence(1))}
    assert odd.by_text((r.doc_id, r.text) for r in clean.collect()) == odd.by_text(
        x for x in odd.texts() if x not in leaked
    )


def test_a_filter_that_lets_all_pass_changes_nothing(spark):
    items = spark.createDataFrame(benchmark(), "item_id bigint, text string")
    out = contained_items(odd.documents(spark), items, filter_bits=1 << 15).collect()
    got = [(r.doc_id, r.item_id, r.n_item_shingles, r.n_common) for r in out]
    assert odd.by_text(got) == odd.by_text(odd.contained(odd.texts(), benchmark()))


def test_one_item_in_a_document_of_many(spark):
    items = [(i, odd.sentence(i, 13)) for i in range(0, 400, 9)]
    rows = [(1, "\n".join(t for _, t in items)), (2, items[5][1] + " tail")]
    out = contained_items(odd.documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_common) for r in out.collect()}
    assert got == odd.contained(rows, items)


def test_coordinates_meet_the_stated_miss():
    for item_class in range(1, 8):
        for size_class in range(item_class, 16):
            n = coordinates(item_class, size_class, 80)
            if n is not None:
                least, most = 2 ** (item_class - 1) + 1, 2**size_class
                similarity = 0.8 * least / (most + 0.2 * least)
                assert n < most and (1 - similarity) ** n <= 1e-9


def test_empty_tables(spark):
    none, items = odd.documents(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert near.near_duplicates(none).collect() == []
    assert near.near_dedup(none).collect() == []
    assert contained_items(odd.documents(spark), items).collect() == []
    assert contained_items(none, spark.createDataFrame(benchmark(), "item_id bigint, text string")).collect() == []
    assert len(decontaminate(odd.documents(spark), items).collect()) == len(odd.texts())


def test_words_are_cut_at_ascii_space_only():
    assert words_of("a b\x1cc d\x0b\x0ce", fold=True) == ["a b\x1cc".encode(), b"d", b"e"]
