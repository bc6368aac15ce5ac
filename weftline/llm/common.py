"""Shared helpers: storage, text columns, batch sizes, Bloom filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut, drop, drop_path, new_path  # noqa: F401

#: A filter takes 2**MOST_BITS bits (256 MB) at the most, whatever the corpus.
MOST_BITS = 31
_BLOCK_BITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_groups(batches, text_col: str = "text", limit: int = 1_000_000):
    """Slices of Arrow batches with about ``limit`` bytes of text each, so that
    what one step holds is bounded whatever the lengths of rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text_col))
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(sizes.searchsorted(base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


class Bloom:
    """A bit for the top bits of each 64-bit hash: no key is missed, some others
    pass.  About ten bits a key up to MOST_BITS in all; past that it lets more
    through, and the join behind it decides as before."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        self.words = np.zeros(1 << bits - 6, np.uint64)
        for b, raw in blocks.items():
            own = np.frombuffer(raw, "<u8")
            self.words[b * len(own) : (b + 1) * len(own)] = own

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        p = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def bloom(keys: DataFrame, hashed: Column, n: int) -> Bloom:
    """The filter of about ``n`` keys with 64-bit hash ``hashed``, put together in
    blocks of 8 KB by the executors."""
    bits = min(MOST_BITS, max(_BLOCK_BITS, (10 * n).bit_length()))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << _BLOCK_BITS, np.uint8)
        flags[pdf["p"].to_numpy() & ((1 << _BLOCK_BITS) - 1)] = 1
        return pd.DataFrame({"b": pdf["b"].iloc[:1], "raw": [np.packbits(flags, bitorder="little").tobytes()]})

    places = keys.select(F.shiftrightunsigned(hashed, 64 - bits).alias("p")).distinct().withColumn("b", F.shiftright("p", _BLOCK_BITS).cast("int"))
    return Bloom(bits, {r.b: bytes(r.raw) for r in places.groupBy("b").applyInPandas(block, "b int, raw binary").collect()})
