"""WARC bundles and chat formatting: round trips on odd tables."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from cohortspan.llm import chat_format as chats
from cohortspan.llm import warc

from tests.llm import odd


def pages():
    rows = [(5, "http://a/\r\nx é%20", "same"), (3, None, "same"), (9, "u", None), (8, "u", ""), (4, "u", "é" * 70_000)]
    rows += [(None, "n", "same"), (None, "n", "lone"), (6, "", "WARC/1.1\r\n\r\n"), (3, None, "same")]
    return rows + [(100 + i, f"http://h/{i}", f"<p>{i % 7}</p>" * 50) for i in range(60)]


def expected_records(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    made = []
    for i, url, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        original = first.get(html or "")
        refers = original if original is not None and original != i else None
        made.append((i, url, len(data), digest, "response" if refers is None else "revisit", refers))
    return made


def page_table(spark, rows):
    made = [(*r, 1, "x") for r in rows]
    return spark.createDataFrame(made, "page_id bigint, url string, html string, size int, digest string")


@pytest.fixture(scope="module")
def bundles(spark):
    originals = warc.with_originals(page_table(spark, pages()))
    return warc.write_bundles(originals, frame_bytes=2000, bundle_bytes=1500).cache()


def test_records_come_back(bundles):
    got = [tuple(r) for r in warc.read_bundles(bundles).collect()]
    assert odd.by_text(got) == odd.by_text(expected_records(pages()))


def test_bundles_are_seekable_archives(bundles):
    import io

    import zstandard

    rows = bundles.collect()
    assert len(rows) > 3
    for row in rows:
        reader = warc.BundleReader(bytes(row.archive))
        frames = [reader.frame(i) for i in range(len(reader.frames))]
        # a reader that knows nothing of the seek table sees the same stream
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(row.archive), read_across_frames=True)
        assert stream.read() == b"".join(frames)
        for r in row.records:
            head, _, end = warc.parse_record(frames[r.frame], r.offset)
            assert end - r.offset == r.length
            assert head["WARC-Record-ID"] == warc._identifier(r.page_id)


def test_fetch_by_identifier(spark, bundles):
    wanted = spark.createDataFrame([(4,), (100,), (107,), (77,)], "page_id bigint")
    got = {r.page_id: r.payload and bytes(r.payload) for r in warc.fetch_records(bundles, wanted).collect()}
    assert got == {4: ("é" * 70_000).encode(), 100: b"<p>0</p>" * 50, 107: None}


def test_small_payloads_are_never_revisits(spark):
    out = warc.with_originals(page_table(spark, pages()), min_bytes=10).collect()
    assert all(r.refers_to is None for r in out if len(r.payload.encode()) < 10)
    assert any(r.refers_to is not None for r in out)


def test_damage_is_noticed(spark, bundles):
    row = bundles.where(F.exists("records", lambda r: r["page_id"] == 4)).first()
    reader = warc.BundleReader(bytes(row.archive))
    place = next(r for r in row.records if r.page_id == 4)
    data = reader.frame(place.frame).replace("éé".encode(), "éè".encode())
    head, block, _ = warc.parse_record(data, place.offset)
    with pytest.raises(ValueError):
        warc._described(head, block)


def test_empty_pages(spark):
    none = warc.write_bundles(warc.with_originals(page_table(spark, [])))
    assert none.collect() == [] and warc.read_bundles(none).collect() == []


SAID = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] \\", "<<SYS>> [TEXT] <", "", None, "é\n<s></SYS>[/TURN]", "[TURN]x[TEXT]"]


def turns():
    rows = [(1, t, role, SAID[t]) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(2, 0, "assistant", SAID[5]), (2, 1, "assistant", SAID[6]), (3, 0, "tool [TEXT]", SAID[0]), (3, 1, None, "x")]
    rows += [(4, None, "user", "first"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b"), (None, 0, "user", "no id")]
    return rows


def test_chats_come_back(spark):
    table = spark.createDataFrame([(*r, "x") for r in turns()], "conv_id bigint, turn bigint, role string, text string, turns string")
    made = chats.format_chats(table).withColumn("formatted", chats.formatted_text(F.col("segments")))
    out = made.select(
        "*", chats.read_back(F.col("formatted")).alias("back"), chats.loss_text(F.col("segments")).alias("learned")
    ).collect()
    by_conv = {}
    for conv, turn, role, text in turns():
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert {r.conv_id for r in out} == set(by_conv)
    for r in out:
        expected = [x[1:] for x in sorted(by_conv[r.conv_id])]
        assert [tuple(t) for t in r.back] == expected
        assert r.learned == "".join(text for role, text in expected if role == "assistant")
        assert r.valid == (r.conv_id == 1)


def test_no_control_string_survives_in_a_text(spark):
    table = spark.createDataFrame([(s,) for s in SAID if s], "text string")
    for r in table.select("text", chats.escaped(F.col("text")).alias("e")).collect():
        assert not any(c in r.e for c in chats.TEMPLATE.controls)


def test_template_is_checked():
    with pytest.raises(ValueError):
        chats.Template({"user": chats.Turn("(", ")")}, chats.TEMPLATE.other, "[TEXT]", {}, ())


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chats.format_chats(none).collect() == []
