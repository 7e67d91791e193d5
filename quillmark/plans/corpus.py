"""Registered queries of the general operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.operators.instants import normalise_instants
from quillmark.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "submissions").select("submit_row", "submit_time", "campus_tz", "collected_at")
    timed = normalise_instants(rows, "submit_time", "campus_tz", "collected_at", "utc_ms")
    return timed.where("utc_ms is not null").select("submit_row", "utc_ms")


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
