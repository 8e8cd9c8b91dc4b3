"""Count-min sketches merged by Spark.

Partitions send the cells they touched, slice by slice; a slice is merged by one task as its parts come, so a worker holds
one slice whatever the input; and of the merged sketch one bit a cell (count >= at_least) comes back: depth * 2**width_bits / 8 bytes in all, whatever the size of the input.
A count can be too high, never too low.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .shared import MULTIPLIERS, mix

SLICE_BITS = 8


def cells(keys: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    return (mix(keys * MULTIPLIERS[60 + row]) >> np.uint64(64 - width_bits)).astype(np.uint32)


def merged_sketch(table: DataFrame, keys_of, depth: int, width_bits: int, at_least: int = 2):
    """A broadcast list of depth bit arrays. keys_of: record batches of a partition -> arrays of uint64 keys."""
    spark = table.sparkSession
    slice_bits = min(SLICE_BITS, width_bits - 3)
    inner = width_bits - slice_bits

    def partial(record_batches):
        import pyarrow as pa

        held, n = [], 0

        def flush():
            keys = np.concatenate(held)
            for row in range(depth):
                cell, times = np.unique(cells(keys, row, width_bits), return_counts=True)
                cuts = np.searchsorted(cell, np.arange(1, 1 << slice_bits, dtype=np.uint32) << np.uint32(inner))
                parts, twice = np.split(cell, cuts), np.split(times > 1, cuts)
                some = [s for s in range(1 << slice_bits) if len(parts[s])]
                yield pa.RecordBatch.from_arrays([pa.array([row << slice_bits | s for s in some], pa.int32()), pa.array([parts[s].tobytes() for s in some], pa.binary()), pa.array([np.packbits(twice[s]).tobytes() for s in some], pa.binary())], names=["part", "cells", "twice"])

        for keys in keys_of(record_batches):
            held.append(keys)
            n += len(keys)
            if n > 1 << 21:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merge(record_batches):
        """The cells of one slice after another, each merged as its parts come."""
        import pyarrow as pa

        at, total = None, None
        for rb in record_batches:
            for part, one, two in zip(*(rb.column(c).to_pylist() for c in ("part", "cells", "twice")), strict=True):
                if part != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= at_least).tobytes()], pa.binary())], names=["part", "bits"])
                    at, total = part, np.zeros(1 << inner, np.uint8)
                cell = np.frombuffer(one, np.uint32) & np.uint32((1 << inner) - 1)
                total[cell] = np.minimum(total[cell] + 1 + np.unpackbits(np.frombuffer(two, np.uint8), count=len(cell)), 2)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= at_least).tobytes()], pa.binary())], names=["part", "bits"])

    merged = table.mapInArrow(partial, "part int, cells binary, twice binary").repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")
    found = {r.part: r.bits for r in merged.collect()}
    empty = bytes((1 << inner) // 8)
    return spark.sparkContext.broadcast([np.frombuffer(b"".join(found.get(row << slice_bits | s, empty) for s in range(1 << slice_bits)), np.uint8) for row in range(depth)])


def may_hold(bits: list[np.ndarray], keys: np.ndarray, width_bits: int) -> np.ndarray:
    """Whether each key counts at_least in the sketch; true for all that really do."""
    out = np.ones(len(keys), bool)
    for row, plane in enumerate(bits):
        c = cells(keys, row, width_bits)
        out &= (plane[c >> np.uint32(3)] >> (np.uint8(7) - (c & np.uint32(7)).astype(np.uint8))) & 1 == 1
    return out
