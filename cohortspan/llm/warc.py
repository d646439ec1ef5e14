"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a seek table (the
skippable frame of the seekable format). A map leads from record identifiers to frame and offset
inside the frame. Bundles are rows of a table, so that any store that Spark writes to holds them;
the ``archive`` column is a complete ``.warc.zst`` file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import stored, table
from cohortspan.llm.registry import query

#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
LEVEL = 3

#: Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"

BUNDLES = "bundle string, archive binary, records array<struct<page_id:bigint,frame:int,offset:bigint,length:bigint>>"
RECORDS = "page_id bigint, url string, payload_bytes long, payload_digest string, record_type string, refers_to bigint"


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1) and refers_to, the page that first had the payload.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least
    ``min_bytes`` bytes, that with the smallest page_id is the original (``refers_to`` null), others
    refer to it. Smaller payloads and rows that repeat the original's page_id refer to nothing; rows
    without a page_id are never an original. Other columns are not written.

    A payload in a third of all rows is pre-aggregated to one row by partition; the join back can be
    split by Spark, because it exchanges both sides for a key of its own.
    """
    hashed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    firsts = (
        hashed.where(F.col("size") >= min_bytes)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select("digest", "size", "original", F.xxhash64("digest").alias("split"))
    )
    return (
        hashed.withColumn("split", F.xxhash64("digest"))
        .join(firsts, ["digest", "size", "split"], "left")
        .withColumn("refers_to", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")))
        .select("page_id", "url", "payload", "digest", "refers_to")
    )


def _identifier(page_id: int | None) -> str:
    return f"<{ID_PREFIX}{'' if page_id is None else page_id}>"


def _page_id(identifier: str) -> int | None:
    number = identifier.strip("<>").removeprefix(ID_PREFIX)
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, and so the payload's length, not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _identifier(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:  # a URL is stored percent-encoded where it could break a header line
        head["WARC-Target-URI"] = quote(url, safe="!#$&'()*+,/:;=?@[]~-._")
    if revisit:
        head |= {"WARC-Refers-To": _identifier(refers_to), "WARC-Profile": REVISIT_PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset behind it."""
    if not data.startswith(VERSION, at):
        raise ValueError(f"no WARC record at {at}")
    end = data.index(b"\r\n\r\n", at)
    lines = data[at + len(VERSION) : end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, data[start:stop], stop + 4


class BundleWriter:
    """Collects records; ``full`` once the compressed frames reach the size of a bundle."""

    def __init__(self, frame_bytes: int, level: int) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.records: list[dict] = []
        self.compressed = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        place = {"frame": len(self.frames), "offset": len(self.open), "length": len(record)}
        self.records.append({"page_id": page_id} | place)
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.compressed += len(frame)
            self.open = bytearray()

    def finish(self) -> bytes:
        self._close_frame()
        entries = b"".join(struct.pack("<II", *size) for size in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        head = struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer))
        return b"".join([*self.frames, head, entries, footer])


class BundleReader:
    """Frames of one archive, found by its seek table."""

    def __init__(self, archive: bytes) -> None:
        import zstandard

        self.archive, self.decompressor = archive, zstandard.ZstdDecompressor()
        count, flags, magic = struct.unpack("<IBI", archive[-9:])
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("the archive has no seek table")
        table_at = len(archive) - 9 - 8 * count
        self.frames, at = [], 0
        for i in range(count):
            size, whole = struct.unpack_from("<II", archive, table_at + 8 * i)
            self.frames.append((at, size, whole))
            at += size

    def frame(self, number: int) -> bytes:
        at, size, whole = self.frames[number]
        return self.decompressor.decompress(self.archive[at : at + size], max_output_size=whole)


def write_bundles(
    originals: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL
) -> DataFrame:
    """Bundles of the records of ``with_originals``: bundle, archive, records (the map).

    A record longer than a frame has a frame of its own. Without rows there is no bundle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        writer = BundleWriter(frame_bytes, level)

        def bundle() -> pd.DataFrame:
            name = f"{task:06d}-{number:06d}"
            return pd.DataFrame({"bundle": [name], "archive": [writer.finish()], "records": [writer.records]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(
                *[batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")]
            ):
                page = None if pd.isna(page_id) else int(page_id)
                refers = None if pd.isna(refers_to) else int(refers_to)
                writer.add(page, record_bytes(page, url, payload.encode(), digest, refers))
                if writer.compressed >= bundle_bytes:
                    yield bundle()
                    writer, number = BundleWriter(frame_bytes, level), number + 1
        if writer.records:
            yield bundle()

    # page ids travel as text: pandas would turn a nullable number into a float
    exact = originals.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return exact.mapInPandas(run, BUNDLES)


def _described(head: dict[str, str], block: bytes) -> dict:
    """A row of RECORDS; the payload of a response is held against its digest."""
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (
        len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
    ):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return {
        "page_id": _page_id(head["WARC-Record-ID"]),
        "url": unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": head["WARC-Type"],
        "refers_to": _page_id(head["WARC-Refers-To"]) if revisit else None,
    }


def _frame_of_rows(rows: list[dict]) -> pd.DataFrame:
    made = pd.DataFrame(rows)
    return made.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the archives, one row each, without its payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["archive"]:
                reader = BundleReader(archive)
                for number in range(len(reader.frames)):
                    data, at, rows = reader.frame(number), 0, []
                    while at < len(data):
                        head, block, at = parse_record(data, at)
                        rows.append(_described(head, block))
                    yield _frame_of_rows(rows)

    return bundles.select("archive").mapInPandas(run, RECORDS)


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id and payload of the ``wanted`` page_ids (null for revisits), by the map: only frames
    that hold one are decompressed. Ids that no record has give no row."""
    places = (
        bundles.select("bundle", F.explode("records").alias("r"))
        .select("bundle", "r.*")
        .join(wanted.select("page_id").distinct(), "page_id")
        .groupBy("bundle")
        .agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, places in zip(batch["archive"], batch["places"]):
                reader, rows, held = BundleReader(archive), [], (-1, b"")
                for place in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                    if held[0] != place["frame"]:
                        held = (place["frame"], reader.frame(place["frame"]))
                    head, block, _ = parse_record(held[1], place["offset"])
                    payload = block.split(b"\r\n\r\n", 1)[1] if head["WARC-Type"] == "response" else None
                    rows.append({"page_id": _page_id(head["WARC-Record-ID"]), "payload": payload})
                yield pd.DataFrame(rows).astype({"page_id": "Int64"})

    return (
        bundles.select("bundle", "archive").join(places, "bundle").select("archive", "places")
        .mapInPandas(run, "page_id bigint, payload binary")
    )


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda h: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', h) - 3, 4)), '') AS b
  FROM p
)
SELECT page_id, strlen(payload) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
    + CAST(substr(b, 5 * i + 5, 1) AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM bits WINDOW w AS (PARTITION BY payload)
"""


@query("op2_warc", SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = stored(write_bundles(with_originals(table(spark, sf_dir, "pages"))), "warc")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
