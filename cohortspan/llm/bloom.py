"""A filter of fixed size over 64-bit hashes that every task may hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 32768


class HashFilter:
    """Two bits for each hash in ``hashes`` (h bigint), of ``bits`` (a power of two, at most 2^32).

    Says yes for every hash given and for some others; the fuller, the more. The driver gets at most
    ``bits / 32,768`` rows of 4 KB, whatever the number of hashes.
    """

    def __init__(self, hashes: DataFrame, bits: int) -> None:
        low = F.expr(f"h & {bits - 1}L")
        high = F.expr(f"shiftrightunsigned(h, 32) & {bits - 1}L")
        places = hashes.select(F.explode(F.array(low, high)).alias("at"))
        chunks = (
            places.select(F.expr(f"at DIV {_CHUNK}").alias("chunk"), F.expr(f"at % {_CHUNK}").alias("bit"))
            .groupBy("chunk")
            .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
        )
        table = np.zeros(max(bits, _CHUNK) // 8, np.uint8)
        for row in chunks.toLocalIterator():
            table[row["chunk"] * (_CHUNK // 8) :][: _CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
        self.mask = np.uint64(bits - 1)
        self.table = hashes.sparkSession.sparkContext.broadcast(table)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        table = self.table.value

        def is_set(at: np.ndarray) -> np.ndarray:
            at = (at & self.mask).astype(np.int64)
            return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1

        return (is_set(hashes) & is_set(hashes >> np.uint64(32))).astype(bool)
