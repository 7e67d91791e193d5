"""Values that occur in too many records to tell anything: found by document frequency, then left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_values(pairs: DataFrame, record: str, value: str, min_count: int = 5, min_ratio: float = 0.2) -> DataFrame:
    """(value, records) for values in at least ``min_count`` records and ``min_ratio`` of all records.

    The number of all records is one row; the values are counted after a distinct that combines map-side.
    """
    seen = pairs.select(record, value).where(F.col(value).isNotNull()).distinct()
    per = seen.groupBy(value).agg(F.count(F.lit(1)).alias("records"))
    n = pairs.agg(F.countDistinct(record).alias("n"))
    out = per.crossJoin(n).where((F.col("records") >= min_count) & (F.col("records") >= min_ratio * F.greatest("n", F.lit(1))))
    return out.select(value, "records")


def without_common(pairs: DataFrame, record: str, value: str, min_count: int = 5, min_ratio: float = 0.2) -> DataFrame:
    """``pairs`` without the common values.  The list of common values is at most 1 / min_ratio times the mean
    number of values of a record, whatever the size of the data."""
    return pairs.join(common_values(pairs, record, value, min_count, min_ratio), value, "left_anti")


def shared_value_pairs(pairs: DataFrame, record: str, value: str) -> DataFrame:
    """(a, b, shared) for records with a value in common, a < b; leave out common values first."""
    seen = pairs.select(F.col(record).alias("r"), F.col(value).alias("v")).where("r is not null and v is not null").distinct()
    a, b = seen.toDF("a", "v"), seen.toDF("b", "v")
    return a.join(b, "v").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
