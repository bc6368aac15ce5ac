"""HyperLogLog as a relation: (key, idx, val), rows only for val > 0.

Registers are maxima, so a sketch is one pre-aggregated groupBy, merging is
another, and a batch or a stream can add to them at any time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import integer_hash64
from .registers import merged, pack, unpack


def _check(b: int) -> int:
    if not 4 <= b <= 15:
        raise ValueError("b lies between 4 and 15")
    return 1 << b


def alpha(b: int) -> float:
    return {4: 0.673, 5: 0.697, 6: 0.709}.get(b, 0.7213 / (1 + 1.079 / (1 << b)))


def register_index(hashed: Column, b: int) -> Column:
    return hashed.bitwiseAND(F.lit(_check(b) - 1)).cast("int")


def register_value(hashed: Column, b: int) -> Column:
    """Trailing zeros of the rest, plus 1."""
    rest = F.shiftrightunsigned(hashed, b)
    return (F.bit_count(F.bitwise_not(rest).bitwiseAND(rest - 1)) + 1).cast("int")


def hll_registers(df: DataFrame, b: int, seed: int) -> DataFrame:
    """``df`` (key, value) -> (key, idx, val).  Null values are not counted."""
    hashed = df.filter("value is not null").select("key", integer_hash64(F.col("value").cast("long"), seed).alias("h"))
    return hashed.select("key", register_index(F.col("h"), b).alias("idx"), register_value(F.col("h"), b).alias("val")).groupBy("key", "idx").agg(F.max("val").alias("val"))


def hll_registers_of_sizes(df: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """``df`` (key, value) -> (key, idx, val, b) for several sizes, each value hashed once."""
    hashed = df.filter("value is not null").select("key", integer_hash64(F.col("value").cast("long"), seed).alias("h"))
    kinds = F.array(*(F.struct(F.lit(b).alias("b"), register_index(F.col("h"), b).alias("idx"), register_value(F.col("h"), b).alias("val")) for b in sizes))
    return hashed.select("key", F.explode(kinds).alias("r")).groupBy("key", "r.b", "r.idx").agg(F.max("r.val").alias("val")).select("key", "idx", "val", "b")


def hll_union(*registers: DataFrame) -> DataFrame:
    """Merge register relations: the maximum of every register."""
    out = registers[0]
    for r in registers[1:]:
        out = out.unionByName(r)
    return out.groupBy("key", "idx").agg(F.max("val").alias("val"))


def hll_rollup(registers: DataFrame, key: Column) -> DataFrame:
    """Merge the sketches of keys that share ``key``."""
    return registers.groupBy(key.alias("key"), "idx").agg(F.max("val").alias("val"))


def hll_changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether a merge changed any register."""
    return not after.join(before, ["key", "idx", "val"], "left_anti").isEmpty()


def estimate_of(power_sum: Column, zeros: Column, b: int) -> Column:
    """From the sum of 2^-val over all registers and the number still zero."""
    m = _check(b)
    raw = F.lit(alpha(b) * m * m) / power_sum
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / zeros)
    large = F.lit(-(2.0**32)) * F.log(1 - raw / F.lit(2.0**32))
    return F.when((raw <= 2.5 * m) & (zeros > 0), linear).when(raw > 2.0**32 / 30, large).otherwise(raw)


def estimate_dense(registers: np.ndarray, b: int) -> np.ndarray:
    """The same for rows of all registers, zeros included."""
    m = _check(b)
    raw = alpha(b) * m * m / np.exp2(-registers.astype(np.float64)).sum(1)
    zeros = (registers == 0).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        linear, large = m * np.log(m / zeros), -(2.0**32) * np.log(1 - raw / 2.0**32)
    return np.where((raw <= 2.5 * m) & (zeros > 0), linear, np.where(raw > 2.0**32 / 30, large, raw))


def hll_estimate(registers: DataFrame, b: int) -> DataFrame:
    """(key, estimate)."""
    m = _check(b)
    sums = registers.groupBy("key").agg(F.sum(F.pow(F.lit(2.0), -F.col("val"))).alias("p"), F.count(F.lit(1)).alias("used"))
    zeros = F.lit(m) - F.col("used")
    return sums.select("key", estimate_of(F.col("p") + zeros, zeros, b).alias("estimate"))


def hll_error(b: int) -> tuple[float, float]:
    """Relative standard error, both ways."""
    e = 1.04 / math.sqrt(_check(b))
    return -e, e


def hll_estimate_range(registers: DataFrame, b: int) -> DataFrame:
    """(key, estimate, low, high), one standard error either way."""
    low, high = hll_error(b)
    e = F.col("estimate")
    return hll_estimate(registers, b).select("key", "estimate", (e * (1 + low)).alias("low"), (e * (1 + high)).alias("high"))


def register_width(n: int) -> int:
    """Bits that registers need when up to n elements are expected."""
    return max(5, math.ceil(math.log2(math.log2(n)))) if n > 2 else 5


def hll_compact(registers: DataFrame, b: int, n: int) -> DataFrame:
    """(key, packed): all registers of a key in turn, each in the bits that up to
    ``n`` elements need; fails on a register that does not fit."""
    width = register_width(n)
    held = registers.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("held"))
    fits = F.when(F.exists(F.map_values("held"), lambda v: v >= 1 << width), F.raise_error(F.lit(f"a register does not fit {width} bits"))).otherwise(F.lit(0))
    dense = F.transform(F.sequence(F.lit(0), F.lit(_check(b) - 1)), lambda i: (F.coalesce(F.element_at("held", i), F.lit(0)) + fits).cast("tinyint"))
    return held.select("key", pack(dense, width).alias("packed"))


def hll_merge_packed(packed: DataFrame, b: int, n: int, key: Column | None = None) -> DataFrame:
    """Packed sketches (key, packed) of one size and ``n`` merged by ``key`` (their own
    unless given) as they are: no register becomes a row."""
    rows = packed.select((F.col("key") if key is None else key).cast("long").alias("key"), F.col("packed").alias("regs")).filter("key is not null")
    return merged(rows, _check(b), register_width(n)).withColumnRenamed("regs", "packed")


def hll_expand(packed: DataFrame, b: int, n: int) -> DataFrame:
    """The registers of :func:`hll_compact` as a relation again."""
    dense = unpack(F.col("packed"), register_width(n), _check(b))
    return packed.select("key", F.posexplode(dense).alias("idx", "val")).filter("val > 0").select("key", "idx", F.col("val").cast("int"))


def approx_distinct(df: DataFrame, b: int = 12) -> DataFrame:
    """(key, estimate) by Spark's own mergeable sketch: the fast path where the
    formula above is not needed."""
    return df.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("value", F.lit(b))).alias("estimate"))
