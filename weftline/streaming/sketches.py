"""Distinct counts over a stream: registers are maxima, so windows of them are an
ordinary watermarked aggregation, late rows included until the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sketch
from ..functions.hashing import integer_hash64


def windowed_registers(stream: DataFrame, value: str, time: str, window: str, late: str, b: int, seed: int) -> DataFrame:
    """(start, idx, val): the registers of each window."""
    hashed = stream.withWatermark(time, late).select(F.window(time, window).alias("w"), integer_hash64(F.col(value).cast("long"), seed).alias("h"))
    return (
        hashed.groupBy("w", sketch.register_index(F.col("h"), b).alias("idx")).agg(F.max(sketch.register_value(F.col("h"), b)).alias("val"))
        .select(F.col("w.start").alias("start"), "idx", "val")
    )


def windowed_degrees(stream: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(start, vertex, degree) of an arc stream (src, dst, time)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree")).select(F.col("w.start").alias("start"), "vertex", "degree")
