"""Byte-level BPE encoding and decoding as a tree reduction.

A text is cut in halves down to leaves, which the library encodes. Two neighbours are joined by
encoding a window around their border anew. The window grows until it begins and ends at cuts that
no piece of the splitting pattern can straddle: tokens outside then are those of the joined text.
Decoding concatenates the bytes of halves up the same kind of tree.

The work is per document, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import mapped_column, table, text_or_empty
from cohortspan.llm.registry import query

#: Characters (or tokens, when decoding) that a leaf holds at most.
LEAF = 16_384
#: Characters on each side of a border that the first window covers.
WINDOW = 64

#: A character that isn't white space, before ASCII white space. Every piece of the pattern has
#: white space at its start or consists of it, so a piece ends here in any text.
_CUT = re.compile(r"\S(?=[ \t\n\r])")


class Codec:
    """Ranks of a vocabulary file, with the pattern that splits text before merging."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of ``left + right`` from those of both."""
        span = self.window
        while True:
            begin, end = self._cut_before(left, span), self._cut_after(right, span)
            whole = begin == 0 and end == len(right)
            stays = self._tokens_before(left_ids, len(left[begin:].encode()))
            starts = self._tokens_after(right_ids, len(right[:end].encode()))
            if whole or (stays is not None and starts is not None):
                again = self.encoding.encode_ordinary(left[begin:] + right[:end])
                return again if whole else left_ids[:stays] + again + right_ids[starts:]
            span *= 2

    def _cut_before(self, left: str, span: int) -> int:
        """The last safe cut at least ``span`` before the end of ``left``; its start if it has none."""
        upto = len(left) - span
        while upto > 0:
            low = max(0, upto - span)
            found = [m.end() for m in _CUT.finditer(left, low, upto + 1) if m.end() <= upto]
            if found:
                return found[-1]
            upto, span = low, span * 2
        return 0

    def _cut_after(self, right: str, span: int) -> int:
        found = _CUT.search(right, span)
        return found.end() if found else len(right)

    def _tokens_before(self, ids: list[int], size: int) -> int | None:
        """How many ids stay when the last ``size`` bytes go; None if a token straddles the place."""
        at = len(ids)
        while size > 0 and at:
            at -= 1
            size -= len(self.tokens[ids[at]])
        return at if size == 0 else None

    def _tokens_after(self, ids: list[int], size: int) -> int | None:
        at = 0
        while size > 0 and at < len(ids):
            size -= len(self.tokens[ids[at]])
            at += 1
        return at if size == 0 else None

    def decode(self, ids) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def encode_documents(
    documents: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids"
) -> DataFrame:
    """``documents`` with a column of token ids; a column of that name is replaced.

    A null text has no tokens, like an empty one. Rows are taken one by one, so repeated rows, null
    ids and empty tables need no rule.
    """

    def of():
        own = codec(path, pattern)

        def value(column: pa.Array) -> pa.Array:
            found = [np.array(own.encode(x.as_py() or ""), np.int32) for x in column]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int32)
            return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *found]))

        return value

    made = T.StructField(ids, T.ArrayType(T.IntegerType()), True)
    return mapped_column(documents, text, made, pa.list_(pa.int32()), of)


def decode_documents(
    documents: DataFrame, path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded"
) -> DataFrame:
    """``documents`` with a column of the bytes that the ids stand for; null ids give no bytes."""

    def of():
        own = codec(path, pattern)

        def value(column: pa.Array) -> pa.Array:
            values, bounds = column.values.to_numpy(), column.offsets.to_numpy()
            return pa.array([own.decode(values[a:b].tolist()) for a, b in zip(bounds, bounds[1:])], pa.binary())

        return value

    made = T.StructField(decoded, T.BinaryType(), True)
    return mapped_column(documents, ids, made, pa.binary(), of)


def production_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    vocabulary = production_vocabulary()
    encoded = encode_documents(documents, *vocabulary).select("doc_id", "token_ids")
    return decode_documents(encoded, *vocabulary).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
