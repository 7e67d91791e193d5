"""Exact running totals over a sorted table, without any group in one task.

The table is range-partitioned by (group, order), so that a group of any size lies in many partitions;
running sums inside the partitions get the totals of the earlier partitions of the same group added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.session import materialise


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    weight: Column | None = None,
    out: str = "position",
    total: str | None = "group_total",
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with the sum of ``weight`` (1: the row's position) up to and including each row of its group.

    ``order`` must be total within a group, else ties come in any order.  A null in ``group`` is a group
    of its own.  The sorted table is written once: the boundaries of a range partitioning are not the
    same again if an executor is lost between the two passes.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    keys = [F.col(c) for c in group]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.withColumn("__w", w)
    ranged = ranged.repartitionByRange(partitions, *keys, *order) if partitions else ranged.repartitionByRange(*keys, *order)
    ranged = materialise(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__part", *group).agg(F.sum("__w").alias("__sum"))
    # One row for each partition and group in it: at most partitions + groups rows, sorted by group.
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns(
        {
            "__before": F.coalesce(F.sum("__sum").over(before), F.lit(0)),
            "__total": F.sum("__sum").over(Window.partitionBy(*group)),
        }
    ).drop("__sum")
    local = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("__local", F.sum("__w").over(local))
    on = [F.col("r.__part") == F.col("s.__part")] + [F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in group]
    joined = rows.alias("r").join(sums.alias("s"), on)
    kept = [F.col(f"r.`{c}`") for c in df.columns]
    extra = [(F.col("__local") + F.col("__before")).alias(out)]
    if total:
        extra.append(F.col("__total").alias(total))
    return joined.select(*kept, *extra)
