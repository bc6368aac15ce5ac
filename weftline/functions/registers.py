"""Small unsigned registers as arrays, and packed in bytes.

Arrays of TINYINT serve all operators; Parquet packs them by itself.  The
packed form (big-endian bits, one register after the other) is for exchange, and
merges as it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zeros(capacity: int) -> Column:
    return F.array_repeat(F.lit(0).cast("tinyint"), capacity)


def get(registers: Column, index) -> Column:
    return F.get(registers, F.lit(index) if isinstance(index, int) else index)


def put(registers: Column, index: Column, value: Column) -> Column:
    return F.transform(registers, lambda x, i: F.when(i == index, value.cast("tinyint")).otherwise(x))


def merge(a: Column, b: Column) -> Column:
    """The larger of every two registers."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def changed(a: Column, b: Column) -> Column:
    """Whether merging b into a changes a."""
    return F.exists(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["y"] > p["x"])


def pack(registers: Column, width: int) -> Column:
    if not 1 <= width <= 7:
        raise ValueError("a register has 1 to 7 bits")

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return _by_length(s, lambda rows: [r.tobytes() for r in pack_rows(rows.astype(np.uint8), width)])

    return run(registers)


def unpack(packed: Column, width: int, capacity: int) -> Column:
    @F.pandas_udf("array<tinyint>")
    def run(s: pd.Series) -> pd.Series:
        flat = s.map(lambda p: np.frombuffer(p, np.uint8), na_action="ignore")
        return _by_length(flat, lambda rows: list(unpack_rows(rows, width, capacity).astype(np.int8)))

    return run(packed)


def _by_length(s: pd.Series, fn) -> pd.Series:
    """``fn`` of the arrays of each length as one matrix; nulls stay."""
    out = pd.Series([None] * len(s), index=s.index, dtype=object)
    sizes = s.map(len, na_action="ignore")
    for n in sizes.dropna().unique():
        own = sizes == n
        out[own] = pd.Series(fn(np.stack(s[own].tolist())), index=s.index[own], dtype=object)
    return out


def size(registers: Column) -> Column:
    return F.size(registers)


def width_of(packed: Column, capacity: int) -> Column:
    """Bits a register of a packed array of eight registers or more."""
    if capacity < 8:
        raise ValueError("fewer than eight registers may share their last byte")
    return (F.octet_length(packed) * 8 / capacity).cast("int")


def pack_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """A row of bytes for each row of registers."""
    if (rows >> width).any():
        raise ValueError(f"a value does not fit {width} bits")
    if width == 8:
        return rows
    bits = (rows[:, :, None] >> np.arange(width - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(rows), -1), axis=1)


def unpack_rows(rows: np.ndarray, width: int, capacity: int) -> np.ndarray:
    if width == 8:
        return rows
    bits = np.unpackbits(rows, axis=1, count=width * capacity).reshape(len(rows), capacity, width)
    return bits @ (1 << np.arange(width - 1, -1, -1)).astype(np.uint8)


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of ``width`` bytes as a matrix, without a copy."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[at : at + len(column) * width].reshape(-1, width)


def packed_rows(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def merged(packed: DataFrame, capacity: int, width: int = 8) -> DataFrame:
    """``packed`` (key long, regs binary) -> one row a key, each register the largest of
    its rows; keys are not null.  A task merges what it has before it sends it on, so a
    key brings as many rows to its partition as there are batches at most, and
    that one merges its sorted rows."""
    size = -(-capacity * width // 8)

    def partial(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            rows = np.maximum.reduceat(unpack_rows(rows_of(batch.column(1), size)[order], width, capacity), first)
            yield pa.RecordBatch.from_arrays([pa.array(key[order][first]), packed_rows(pack_rows(rows, width))], ["key", "regs"])

    def final(batches):
        key = held = None  # the last key of the batch before may go on

        def row(key, values):
            return pa.RecordBatch.from_arrays([pa.array(key), packed_rows(pack_rows(values, width))], ["key", "regs"])

        for batch in partial(batches):
            keys, rows = batch.column(0).to_numpy(), unpack_rows(rows_of(batch.column(1), size), width, capacity).copy()
            if held is not None and key == keys[0]:
                rows[0] = np.maximum(rows[0], held)
            elif held is not None:
                yield row([key], held[None])
            key, held = int(keys[-1]), rows[-1].copy()
            if len(keys) > 1:
                yield row(keys[:-1], rows[:-1])
        if held is not None:
            yield row([key], held[None])

    schema = "key long, regs binary"
    return packed.select("key", "regs").mapInArrow(partial, schema).repartition("key").sortWithinPartitions("key").mapInArrow(final, schema)


def bits_text(registers: Column, width: int) -> Column:
    """Registers as bits with a bar between them."""
    return F.array_join(F.transform(registers, lambda x: F.lpad(F.bin(x.cast("long")), width, "0")), "|")
