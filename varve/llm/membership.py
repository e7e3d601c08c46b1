"""A bitmap of hashed values that spares a shuffle what cannot be among them.

Bits are set by a distributed aggregation and sent to all tasks. The bitmap has at most
``MAX_BITS`` bits whatever the number of values: when they are many, more rows pass, and the exact
join that follows decides alone. Results never depend on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB at most.
MAX_BITS = 1 << 27
#: Low bits that hold no hash (band or step numbers).
_SKIP = 5


class Bitmap:
    """Where bits are set for the values of a long column whose upper 59 bits are well mixed."""

    def __init__(self, values: DataFrame, column: str, bits_each: int = 64):
        wanted = max(values.count() * bits_each, 1 << 15)
        self.bits = min(1 << (wanted - 1).bit_length(), MAX_BITS)
        slot = F.shiftrightunsigned(column, _SKIP).bitwiseAND(F.lit(self.bits - 1))
        words = values.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        data = np.zeros(self.bits >> 6, dtype=np.int64)
        data[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        data = data.astype("<i8", copy=False).view(np.uint8)
        self.data = values.sparkSession.sparkContext.broadcast(data)

    def passes(self, values: np.ndarray) -> np.ndarray:
        """True where a value may be a member; never false for a member."""
        slot = (values.view(np.uint64) >> np.uint64(_SKIP)) & np.uint64(self.bits - 1)
        return (self.data.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
