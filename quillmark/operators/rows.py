"""Row operators: last and first of a key, ranks, upserts, pair keys, status flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.positions import running_totals


def last_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order``; the aggregation combines before the shuffle, so that a
    key with most of the rows costs no more than others.  Rows with a null in ``order`` come first."""
    rest = [c for c in df.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(row.alias("__r")).select(*key, "__r.*").select(*df.columns)


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(row.alias("__r")).select(*key, "__r.*").select(*df.columns)


def competition_rank(df: DataFrame, group: Sequence[str], value: Column, out: str = "rank") -> DataFrame:
    """Ranks from the highest value down, nulls last; ties share a rank and leave a gap.

    The distinct values of a group are counted first, running totals of the counts give their ranks, and the rows
    get theirs by a join: no window holds a group, whatever its size."""
    rows = df.withColumn("__v", value)
    levels = rows.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = running_totals(levels, group, [F.col("__v").desc()], F.col("__n"), out="__upto", total=None)
    placed = placed.select(*group, "__v", (F.col("__upto") - F.col("__n") + 1).cast("int").alias(out))
    on = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in (*group, "__v")]
    return rows.drop(out).alias("r").join(placed.alias("s"), on).select(*[F.col(f"r.`{c}`") for c in df.columns if c != out], F.col(f"s.`{out}`"))


def position_share(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each row's position in its group and its share of the group's rows; ties get positions by ``order``.
    Exact running totals over ranges of the sorted rows: a group of any size lies in many tasks."""
    placed = running_totals(df, group, order, out="position", total="__n")
    return placed.withColumn("share", F.col("position") / F.col("__n")).drop("__n")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "place") -> DataFrame:
    """The first ``k`` rows of each group; each task keeps but k of a group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose key ``new`` hasn't."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))


def overlay(base: DataFrame, other: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``base`` with ``cols`` of ``other`` where it has a value for the key."""
    o = other.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    return base.join(o, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else c for c in base.columns])


def with_pair_key(df: DataFrame, a: str, b: str) -> DataFrame:
    """The two ids in order, so that a pair and its reverse are the same."""
    return df.withColumns({"low_id": F.least(F.trim(a), F.trim(b)), "high_id": F.greatest(F.trim(a), F.trim(b))})


def both_sides(df: DataFrame, a: str, b: str, *carry: str) -> DataFrame:
    """Each pair twice, once from either side: ``me``, ``other`` and ``carry``."""
    sides = F.array(F.struct(F.col(a).alias("me"), F.col(b).alias("other")), F.struct(F.col(b).alias("me"), F.col(a).alias("other")))
    return df.select(F.inline(sides), *carry)


def marked(df: DataFrame, known: DataFrame, key: str, out: str = "known") -> DataFrame:
    """``df`` with whether its key is among ``known``."""
    flags = known.select(key).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return df.join(flags, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


# Status words.
DONE = "已完成|已批"
PENDING = "待批阅|重做待批阅|批阅"


def completed(status: Column) -> Column:
    return F.coalesce(status.rlike(DONE), F.lit(False))


def pending(status: Column) -> Column:
    return F.coalesce(status.rlike(PENDING) & ~status.rlike(DONE + "|查看"), F.lit(False))
