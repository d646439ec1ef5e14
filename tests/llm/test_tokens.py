"""Byte-level BPE and token counts against the libraries."""

import random

from pyspark.sql import functions as F

from cohortspan.llm import byte_bpe, token_counts

from tests.llm import odd


def long_texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(letters) for _ in range(3000)) for letters in ("ab \n\t'sé!1 ", "   \n\r\t a", "   a", "aé")]
    return made + ["<|endoftext|> foo<|endoftext|>" * 60, " " * 900, "a" * 1500, "\U0001f600 x" * 200, odd.texts()[12][1]]


def test_tree_encoding_is_the_library_s():
    codec = byte_bpe.Codec(*byte_bpe.production_vocabulary(), leaf=40, window=2)
    for text in [*long_texts(), *[t for _, t in odd.texts() if t]]:
        ids = codec.encode(text)
        assert ids == codec.encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_spliced_counts_are_the_library_s():
    counter = token_counts.Counter(token_counts.production_tokenizer(), step=90, overlap=2)
    for text in [*long_texts(), *[t for _, t in odd.texts() if t]]:
        assert counter.spliced(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_encode_and_decode_documents(spark):
    docs = odd.documents(spark)
    path, pattern = byte_bpe.production_vocabulary()
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, pattern), path, pattern)
    assert set(out.columns) == {*docs.columns, "decoded"}
    library = byte_bpe.codec(path, pattern).encoding
    expected = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd.texts()]
    got = [(r.doc_id, r.token_ids, bytes(r.decoded)) for r in out.collect()]
    assert odd.by_text(got) == odd.by_text(expected)


def test_null_ids_decode_to_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, token_ids array<int>")
    out = byte_bpe.decode_documents(docs, *byte_bpe.production_vocabulary()).collect()
    assert [bytes(r.decoded) for r in out] == [b"", b""]


def test_count_tokens(spark):
    docs = odd.documents(spark).withColumn("n_tokens", F.lit("replaced"))
    path = token_counts.production_tokenizer()
    out = token_counts.count_tokens(docs, path)
    library = token_counts.counter(path).tokenizer
    expected = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd.texts()]
    assert odd.by_text((r.doc_id, r.n_tokens) for r in out.collect()) == odd.by_text(expected)


def test_empty_tables(spark):
    none = odd.documents(spark, [])
    assert byte_bpe.encode_documents(none, *byte_bpe.production_vocabulary()).collect() == []
    assert token_counts.count_tokens(none, token_counts.production_tokenizer()).collect() == []
