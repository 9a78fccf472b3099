"""Tables that tell tasks which 64-bit numbers may matter: a bit for each slot that numbers fall in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The size of the tables does not depend on the data: SLOTS bits.
SLOTS = 1 << 24


def slots_of(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def slot_table(rows: DataFrame, number: Column | str) -> np.ndarray:
    """Which slots the numbers of a column fall in, eight in a byte; SLOTS bits are collected, as columns."""
    slot = F.shiftrightunsigned(number, 40).bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
    bit = F.expr("shiftleft(1L, slot & 63)")
    bits = rows.select(slot).groupBy(F.expr("slot >> 6").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(SLOTS // 64, np.int64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return words.view(np.uint8)


def held(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the slots of the numbers are in a table of `slot_table`."""
    slot = slots_of(numbers)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).view(bool)


def unpacked(table: np.ndarray) -> np.ndarray:
    """A table of `slot_table` with a byte for each slot, for tasks that look up few numbers very often."""
    return np.unpackbits(table, bitorder="little").view(bool)
