"""Each registered query against its SQL twin or a plain-Python version; the pipeline."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspan.llm.byte_bpe import codec, production_vocabulary
from cohortspan.llm.catalog import ORACLES, QUERIES
from cohortspan.llm.token_counts import counter, production_tokenizer

from tests.llm import odd

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF_DIR}/{name}'")
    return db


@pytest.fixture(scope="module")
def texts(tables):
    return tables.execute("SELECT doc_id, text FROM documents").fetchall()


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    result = tables.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert odd.by_text(tuple(r) for r in df.select(*names).collect()) == odd.by_text(result.fetchall())


def test_byte_bpe(spark, texts):
    library = codec(*production_vocabulary()).encoding
    expected = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), odd.sha(",".join(map(str, ids))), odd.sha(t or "")))
    assert odd.by_text(tuple(r) for r in QUERIES["op8_byte_bpe"](spark, SF_DIR).collect()) == odd.by_text(expected)


def test_token_counts(spark, texts):
    library = counter(production_tokenizer()).tokenizer
    expected = []
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert odd.by_text(tuple(r) for r in QUERIES["op10_token_counts"](spark, SF_DIR).collect()) == odd.by_text(expected)


def test_suffix_dedup(spark, texts):
    expected = [(i, *r) for (i, _), r in zip(texts, odd.without_strings(texts, 400))]
    assert any(r[2] for r in expected)
    assert odd.by_text(tuple(r) for r in QUERIES["op9_suffix_dedup"](spark, SF_DIR).collect()) == odd.by_text(expected)


def plain_pipeline(rows, items):
    """The texts that each stage but the last keeps."""
    stages = [[(i, t) for i, t in rows if odd.passes(t)]]
    stages.append([(i, "\n".join(kept)) for (i, _), (_, kept) in zip(stages[0], odd.kept_lines(stages[0]))])
    found = odd.components(stages[1], 80)
    stages.append([(i, t) for i, t in stages[1] if i is None or found[i] == i])
    leaked = {i for i, *_ in odd.contained(stages[2], items)}
    stages.append([(i, t) for i, t in stages[2] if i not in leaked])
    return stages


def test_pipeline(spark, tables, texts):
    items = tables.execute("SELECT item_id, text FROM benchmark").fetchall()
    expected = plain_pipeline(texts, items)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], expected):
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert odd.by_text((r.doc_id, r.text) for r in docs.collect()) == odd.by_text(rows), name
    library = codec(*production_vocabulary()).encoding
    out = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "token_ids", "decoded_sha256", F.col("n_tokens"))
    last = [(i, library.encode_ordinary(t or ""), odd.sha(t or ""), len(library.encode_ordinary(t or ""))) for i, t in expected[-1]]
    assert odd.by_text(tuple(r) for r in out.collect()) == odd.by_text(last)


def test_pipeline_on_odd_documents(spark):
    docs = odd.documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    none = odd.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF_DIR)
    assert docs.count() > 0 and none.count() == 0
