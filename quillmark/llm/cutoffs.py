"""A score cut-off for each source that keeps a target fraction of its records.

Each source is sorted by score and identifier, exact positions come from the partitions' counts, and the
score at the target count is the cut-off.  A source with most of the rows lies in many partitions.

Cases: a row without a score doesn't count; a source without a target or without scored rows gives no row;
tied scores are all kept, so that more than the target may be kept; target counts are rounded up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.instants import normalise_instants
from quillmark.operators.positions import running_totals

NO_CLASS = "未分班"


def fraction_cutoffs(scored: DataFrame, targets: DataFrame, source: str, score: str, ident: str, percent: str) -> DataFrame:
    """``source``, ``cutoff`` and ``kept_rows`` for each source; the lowest scores are kept.

    ``targets`` has one row for each source with the whole-number ``percent`` to keep.
    """
    rows = scored.select(F.col(source).alias("s"), F.col(score).alias("x"), F.col(ident).alias("i")).where("s is not null and x is not null")
    placed = running_totals(rows, ["s"], ["x", "i"], out="k", total="n")
    goal = targets.select(F.col(source).alias("s"), F.col(percent).cast("long").alias("p")).where("p > 0").groupBy("s").agg(F.max("p").alias("p"))
    # ceil(p * n / 100) in whole numbers
    placed = placed.join(goal, "s").withColumn("goal", F.expr("(p * n + 99) div 100"))
    cut = placed.where(F.col("k") == F.col("goal")).select("s", F.col("x").alias("cutoff"))
    # Rows up to the cut-off: the last position among the rows that tie with it.
    tied = placed.join(cut, "s").where(F.col("x") == F.col("cutoff"))
    return tied.groupBy(F.col("s").alias(source), "cutoff").agg(F.max("k").alias("kept_rows"))


def class_key(name: Column) -> Column:
    bare = F.lower(F.regexp_replace(name, r"^[\s　]+|[\s　]+$", ""))
    return F.when(name.isNull() | (bare == ""), F.lit(NO_CLASS)).otherwise(bare)


def submission_cutoffs(submissions: DataFrame, class_targets: DataFrame) -> DataFrame:
    """The submit time by which the earliest keep_percent of each class had come in."""
    cols = ["submit_row", "submit_time", "campus_tz", "collected_at", "class_name"]
    last = F.max_by(F.struct(*cols), "submit_row").alias("r")
    # Rows without an id are records of their own.
    own = F.when(F.col("work_answer_id").isNull(), F.col("submit_row"))
    latest = submissions.groupBy("work_answer_id", own.alias("own")).agg(last).select("r.*")
    timed = normalise_instants(latest, "submit_time", "campus_tz", "collected_at").where("utc_ms is not null")
    timed = timed.withColumn("class_key", class_key(F.col("class_name")))
    targets = class_targets.withColumn("class_key", class_key(F.col("class_name")))
    found = fraction_cutoffs(timed, targets, "class_key", "utc_ms", "submit_row", "keep_percent")
    names = targets.groupBy("class_key").agg(F.min("class_name").alias("class_name"))
    return found.join(names, "class_key").select("class_name", F.col("cutoff").alias("cutoff_ms"), "kept_rows")
