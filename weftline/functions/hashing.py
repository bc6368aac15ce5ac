"""64-bit hashing with wrap-around arithmetic, by Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The golden ratio, the shifts of the mix (right, left, right; four
#: rounds), and the multiplier that hashes an integer before it is mixed.
GOLDEN = 0x9E3779B97F4A7C13
SHIFTS = [(43, 9, 8), (38, 23, 5), (35, 49, 11), (12, 18, 22)]
INTEGER = 0x517CC1B727220A95


def jenkins(x: np.ndarray, seed: int) -> np.ndarray:
    """Mix of (x, seed): a, b and c take turns to lose the other two and to be
    xor-ed with a shift of the one changed last."""
    word = np.uint64
    state = [x.astype(word) + word(seed), np.full(len(x), seed, word), np.full(len(x), GOLDEN, word)]
    for shifts in SHIFTS:
        for i, s in enumerate(shifts):
            last = state[i - 1]
            state[i] = state[i] - state[(i + 1) % 3] - state[(i + 2) % 3]
            state[i] ^= last << word(s) if i == 1 else last >> word(s)
    return state[2]


def jenkins64(value: Column, seed: int) -> Column:
    """The mix of a BIGINT column as BIGINT bits."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(jenkins(x.to_numpy(np.int64).view(np.uint64), seed).view(np.int64))

    return run(value)


def integer_hash(x: np.ndarray, seed: int) -> np.ndarray:
    """What sketches register for integers."""
    return jenkins(x.astype(np.int64).view(np.uint64) * np.uint64(INTEGER), seed)


def trailing_zeros(x: np.ndarray) -> np.ndarray:
    """64 for 0."""
    return np.bitwise_count(~x & (x - np.uint64(1))).astype(np.int64)


def integer_hash64(value: Column, seed: int) -> Column:
    """The mix of the multiplied integer: what sketches register."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(integer_hash(x.to_numpy(np.int64), seed).view(np.int64))

    return run(value)
