"""Sinks: CSV in two dialects, JSON, a gated outbox, and batches that remember what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.scalars import csv_guard
from quillmark.operators.rows import completed


def write_csv(df: DataFrame, path: str, guarded: bool = False, headers: dict[str, str] | None = None) -> None:
    """CSV with doubled quotes.  ``guarded`` quotes every cell and defuses formulas; ``headers`` renames columns."""
    cols = [(csv_guard(F.col(c).cast("string")) if guarded else F.col(c)).alias((headers or {}).get(c, c)) for c in df.columns]
    out = df.select(*cols).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "")
    out.option("emptyValue", "").option("quoteAll", guarded).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def outbox(drafts: DataFrame, take_all: bool = False, allow_zero: bool = False) -> DataFrame:
    """The drafts that may be sent: not skipped, with a review URL, approved or all; zero scores only if allowed.
    Completed ones are never sent again."""
    ready = drafts.where(~F.coalesce("skipped", F.lit(False)) & (F.coalesce("review_url", F.lit("")) != "") & ~completed(F.col("status")))
    if not take_all:
        ready = ready.where("approved")
    return ready if allow_zero else ready.where("draft_score > 0")


def run_once(spark: SparkSession, keys: list[str], done_path: str, job: Callable[[str], None]) -> list[str]:
    """Run ``job`` for each key that ``done_path`` doesn't hold, noting each when it ended; stop at the first failure.
    A run after a failure begins where that one stopped."""
    try:
        done = {r["key"] for r in spark.read.schema("key string").json(done_path).collect()}  # the keys given, a few
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    ran = []
    for key in keys:
        if key not in done:
            job(key)
            spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("append").json(done_path)
            ran.append(key)
    return ran
