"""Token counts with overlap resynchronisation.

A huge text is encoded in overlapping chunks, with offsets. Two chunks are spliced where both have a
token boundary and the text shows that there is one in any encoding; an overlap without such a place
is widened. Short texts are encoded whole. The work is per document; nothing is shuffled.
"""

from __future__ import annotations

import os
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import mapped_column, table, text_or_empty
from cohortspan.llm.registry import query

#: Characters by which chunks advance, and the first overlap.
STEP, OVERLAP = 32_768, 256
#: Characters that are given to the library at once.
BATCH = 1 << 20

#: Behind a character that isn't white space and before ASCII white space, byte-level pre-tokens
#: end: white space only begins them. Special strings hold no white space, so none lies across.
_STABLE = re.compile(r"\S(?=[ \t\n\r])")


class Counter:
    """Counts the tokens of a tokenizer file, without added special tokens."""

    def __init__(self, path: str, step: int = STEP, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.step, self.overlap = step, overlap

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of texts, a bounded number of characters at a time."""
        found = [0] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > self.step:
                found[i] = self.spliced(text)
                continue
            held.append(i)
            size += len(text)
            if size >= BATCH:
                self._count(texts, held, found)
                held, size = [], 0
        self._count(texts, held, found)
        return found

    def _count(self, texts: list[str], held: list[int], found: list[int]) -> None:
        encoded = self.tokenizer.encode_batch_fast([texts[i] for i in held], add_special_tokens=False)
        for i, one in zip(held, encoded):
            found[i] = len(one)

    def spliced(self, text: str) -> int:
        """The count of a long text; two neighbouring chunks are held at a time."""
        total, begin = 0, 0  # tokens before ``begin``, a place where a token starts
        while begin + self.step < len(text):
            place, starts = self._splice(text, begin, begin + self.step)
            if place is None:
                break
            total += sum(1 for a in starts if a < place)
            begin = place
        return total + len(self._offsets(text, begin, len(text)))

    def _splice(self, text: str, begin: int, right_at: int) -> tuple[int | None, list[int]]:
        """Where the chunk from ``begin`` and the next, from ``right_at``, agree for good; None if
        the overlap had to grow to the end of the text. With it, the token starts of the left chunk.
        """
        width = self.overlap
        while True:
            end = min(right_at + width, len(text))
            left, right = self._offsets(text, begin, end), self._offsets(text, right_at, end)
            both = {b for _, b in left} & {a for a, _ in right}
            stable = (m.end() for m in _STABLE.finditer(text, right_at, end))
            place = next((p for p in stable if p in both), None)
            if place is not None or end == len(text):
                return place, [a for a, _ in left]
            width *= 2

    def _offsets(self, text: str, begin: int, end: int) -> list[tuple[int, int]]:
        encoded = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return [(a + begin, b + begin) for a, b in encoded.offsets]


@cache
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def count_tokens(documents: DataFrame, path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """``documents`` with the number of tokens of each text; a column of that name is replaced.

    Null and empty texts have 0 tokens. Rows are taken one by one, so repeated rows, null ids and
    empty tables need no rule.
    """

    def of():
        own = counter(path)
        return lambda column: pa.array(own.counts([x.as_py() or "" for x in column]), pa.int64())

    return mapped_column(documents, text, T.StructField(count, T.LongType()), pa.int64(), of)


def production_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    sized = documents.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return count_tokens(sized, production_tokenizer()).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit")
    )
