"""What the operators share: scratch tables, sizes of inputs, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.scratch import discard, materialize, scratch_dir, small_enough, spread

__all__ = ["bucket_count", "discard", "input_bytes", "materialize", "scratch_dir", "small_enough", "spread"]


def input_bytes(df: DataFrame, text_col: str | None = None) -> int:
    """Catalyst's size estimate of the scanned input, which scales partition counts with the
    data; where a source has none, the bytes of its texts are summed, or rows counted."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < 1 << 58:
        return estimate
    size = F.sum(F.octet_length(text_col)) if text_col else F.count(F.lit(1)) * 1000
    return int(df.agg(size.alias("n")).first()["n"] or 0)


def bucket_count(df: DataFrame, bytes_each: int, text_col: str | None = None, least: int = 8) -> int:
    """How many hash buckets keep each at about ``bytes_each`` of the input."""
    return int(max(least, -(-input_bytes(df, text_col) // bytes_each)))
