"""Counters of fixed size over hashed keys, summed on Spark: a bounded summary of any number of rows."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counters in a row on their way through the shuffle.
CHUNK = 1 << 14
ROW = "chunk int, counts binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift), so that any bits of a hash may be used."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slot(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def chunks(total: np.ndarray):
    """The counters of one task as rows; chunks of zeros alone are left out."""
    for k in range(0, len(total), CHUNK):
        part = total[k : k + CHUNK]
        if part.any():
            yield k // CHUNK, zlib.compress(part.astype("<i8").tobytes(), 1)


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counters; what reaches the driver is of this size however many rows there are."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(CHUNK, size), np.int64)
        for x in part["counts"]:
            total += np.frombuffer(zlib.decompress(x), "<i8")
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    out = np.zeros(size, np.int32)  # counts beyond it are held at its end
    for r in rows.select("chunk", "counts").groupBy("chunk").applyInPandas(add, ROW).toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.minimum(np.frombuffer(zlib.decompress(r["counts"]), "<i8"), 2**31 - 1)
    return out


def key_filter(keys: DataFrame, count: int, among: np.ndarray | None = None) -> np.ndarray:
    """Which slots `count` longs of a column take, as bits, 256 for each: a key that is in it always passes, another one rarely.

    among: only keys that this filter lets through are marked. They are looked up in the same function,
    since every further Python function of a stage takes one more worker for each task.
    """
    bits = min(max(count, 64).bit_length() + 8, 27)

    def mark(batches):
        seen = np.zeros(1 << bits - 3, np.uint8)
        for b in batches:
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            s = slot(mixed((x if among is None else x[passes(among, x)]).view(np.uint64)), bits)
            np.bitwise_or.at(seen, s >> 3, (128 >> (s & 7)).astype(np.uint8))
        for k in range(0, len(seen), CHUNK):
            if seen[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([seen[k : k + CHUNK].tobytes()], pa.binary())], ["chunk", "counts"])

    def unite(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "counts": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in part["counts"]]).tobytes()]})

    out = np.zeros(1 << bits - 3, np.uint8)
    for r in keys.mapInArrow(mark, ROW).groupBy("chunk").applyInPandas(unite, ROW).toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint8)
    return out


def passes(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = (len(found) * 8).bit_length() - 1
    s = slot(mixed(keys.astype(np.int64).view(np.uint64)), bits)
    return (found[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 > 0
