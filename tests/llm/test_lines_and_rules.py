"""Line dedup and quality rules against plain Python, on odd tables."""

from pyspark.sql import functions as F

from cohortspan.llm import line_dedup as lines
from cohortspan.llm import quality_rules as rules

from tests.llm import odd


def test_line_dedup(spark):
    docs = odd.documents(spark)
    out = lines.line_dedup(docs)
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = [(i, "\n".join(kept)) for (i, _), (_, kept) in zip(rows, odd.kept_lines(rows))]
    assert odd.by_text((r.doc_id, r.text) for r in out.collect()) == odd.by_text(expected)


def test_bitmaps_are_sparse_and_cut(spark):
    shared = "a line that is found in four documents"
    texts = [(i, "x\n" * 40_000 + shared + "\nend") for i in range(3)] + [(9, shared)]
    out = lines.dropped_lines(odd.documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 2]
    for r in out:
        assert [(c.chunk, len(c.bits)) for c in r.dropped] == [(1, (40_000 - 32_768) // 8 + 1)]


def test_hot_line_stays_in_the_last_document(spark):
    shared = "Every one of these documents has this line"
    docs = odd.documents(spark, [(i, f"{shared}\nown {i}") for i in range(300)])
    out = {r.doc_id: r.text for r in lines.line_dedup(docs).collect()}
    assert out[299] == f"{shared}\nown 299"
    assert all(out[i] == f"own {i}" for i in range(299))


def test_measures_and_cascade(spark):
    docs = odd.documents(spark)
    out = rules.measured_verdicts(docs).collect()
    names = list(rules.MEASURES)
    got = odd.by_text((r.doc_id, *[r[n] for n in names], r.kept) for r in out)
    assert got == odd.by_text((i, *odd.measures(t), odd.passes(t)) for i, t in odd.texts())
    kept = rules.quality_filter(docs)
    assert kept.columns == docs.columns
    expected = [(i, t) for i, t in odd.texts() if odd.passes(t)]
    assert odd.by_text((r.doc_id, r.text) for r in kept.collect()) == odd.by_text(expected)


def test_order_never_changes_the_verdict(spark):
    docs = odd.documents(spark)
    text = F.coalesce("text", F.lit(""))
    ways = [rules.RULES, rules.RULES[::-1]]
    verdicts = [rules.first_failure_of(way, text).isNull().alias(f"v{i}") for i, way in enumerate(ways)]
    apart = rules.first_failure(rules.RULES, {}, text).isNull().alias("v2")
    assert all(r.v0 == r.v1 == r.v2 for r in docs.select(*verdicts, apart).collect())


def test_empty_tables(spark):
    none = odd.documents(spark, [])
    assert lines.line_dedup(none).collect() == []
    assert rules.quality_filter(none).collect() == []
    assert rules.measured_verdicts(none).collect() == []


def test_order_follows_rejections_per_second(spark):
    """A dear rule that rejects as much as a cheap one comes behind it, one that rejects nothing last."""
    docs = odd.documents(spark, [(i, odd.sentence(i, 400)) for i in range(300)])
    every = lambda m: m["n_words"] > 0
    dear = rules.Rule("dear", ("n_repeat_words", "n_words"), lambda m: (m["n_repeat_words"] >= 0) & every(m))
    own = (rules.Rule("never", ("n_words",), lambda m: m["n_words"] < 0), dear, rules.Rule("cheap", ("n_words",), every))
    for _ in range(3):
        assert [r.name for r in rules.sampled_order(docs, own, 100)] == ["cheap", "dear", "never"]


def test_sample_comes_from_the_whole_table(spark):
    ids = spark.range(20_000, numPartitions=8)
    docs = ids.select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    drawn = [int(r.text) for r in rules.text_sample(docs, 400).collect()]
    assert 300 < len(drawn) < 500
    assert all(sum(part * 2_500 <= i < (part + 1) * 2_500 for i in drawn) > 20 for part in range(8))
    assert rules.text_sample(docs.limit(0), 400).count() == 0
    assert len(rules.sampled_order(docs.limit(0))) == len(rules.RULES)
