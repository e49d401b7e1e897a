"""Bit maps of 64-bit hashes, used only to leave surely useless rows out of a shuffle.

A map is sized by the number of its hashes, 32 bits for each, between half a MB and 32 MB. Beyond some 8 million hashes
it stays at the largest size; then more rows pass in vain, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of a map, as powers of two of its bits.
LEAST, MOST = 22, 28


def hash_bits(hashes: DataFrame, column: str = "h", n: int | None = None) -> np.ndarray:
    """The bit map of a column of hashes, ``n`` of them at most (counted if not given); a row for each 64 bits reaches the driver."""
    n = hashes.count() if n is None else n
    bits = min(MOST, max(LEAST, (32 * n).bit_length()))
    word = F.shiftrightunsigned(F.col(column), 64 - bits + 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    out = np.zeros(1 << (bits - 6), np.uint64)
    for batch in hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the map; never false for one that is."""
    slot = hashes >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def parted(df: DataFrame, column: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash (a long column without nulls) is surely not in the map, and the others; only hashes go to Python."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may(h: pa.Array) -> pa.Array:
        return pa.array(among(shared.value, h.to_numpy().view(np.uint64)))

    return df.where(~may(F.col(column))), df.where(may(F.col(column)))
