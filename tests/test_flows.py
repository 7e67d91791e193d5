"""Sources, sinks and batches that remember."""

from __future__ import annotations

import pytest
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from quillmark.sources import readers, sinks

SCHEMA = StructType([StructField("id", StringType()), StructField("ok", BooleanType()), StructField("x", DoubleType()), StructField("t", StringType())])


def test_csv_both_dialects(spark, tmp_path):
    df = spark.createDataFrame([("1", True, 1.5, 'a "b"\nc,d'), ("2", False, None, None), ("3", None, -2.0, "=cmd")], SCHEMA)
    sinks.write_csv(df, str(tmp_path / "a"))
    back = {r["id"]: r for r in readers.read_csv(spark, str(tmp_path / "a"), SCHEMA).collect()}
    assert back["1"]["t"] == 'a "b"\nc,d' and back["1"]["ok"] is True and back["2"]["t"] == "" and back["2"]["x"] is None
    sinks.write_csv(df, str(tmp_path / "b"), guarded=True, headers={"t": "text"})
    guarded = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "b"))
    assert "text" in guarded.columns and {"'=cmd"} <= {r["text"] for r in guarded.collect()}
    assert {"'-2.0"} <= {r["x"] for r in guarded.collect()}


def test_json_tolerant_strict_empty(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"id": "1", "x": 2}\n{"id": broken\n')
    rows = readers.read_json(spark, str(tmp_path / "j"), SCHEMA).cache()
    assert sorted(r["_corrupt"] is not None for r in rows.collect()) == [False, True]
    with pytest.raises(Exception):
        readers.read_json(spark, str(tmp_path / "j"), SCHEMA, strict=True).collect()
    assert readers.read_json_or_empty(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_baseline_and_first_filled(spark):
    cur = spark.createDataFrame([("1", True, 1.0, "a"), ("2", True, 2.0, "b")], SCHEMA)
    base = spark.createDataFrame([("2", "x"), ("2", "y")], "id string, t string").coalesce(1)
    assert {r["id"]: r["t"] for r in readers.with_baseline(cur, base, "id").collect()} == {"1": "a", "2": "y"}
    assert readers.first_filled_source(cur.limit(0), cur).count() == 2


def test_images(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x89PNG\r\n\x1a\n1234")
    (tmp_path / "b.bin").write_bytes(b"text")
    assert {r["mime"] for r in readers.read_images(spark, str(tmp_path)).collect()} == {"image/png", None}


def test_outbox_and_run_once(spark, tmp_path):
    d = spark.createDataFrame([(1, True, False, "u", "待批阅", 5.0), (2, False, False, "u", "待批阅", 5.0), (3, True, True, "u", "待批阅", 5.0), (4, True, False, "", "待批阅", 5.0), (5, True, False, "u", "已批", 5.0), (6, True, False, "u", None, 0.0)], "draft_id int, approved boolean, skipped boolean, review_url string, status string, draft_score double")
    assert [r["draft_id"] for r in sinks.outbox(d).collect()] == [1]
    assert {r["draft_id"] for r in sinks.outbox(d, take_all=True, allow_zero=True).collect()} == {1, 2, 6}
    path, seen = str(tmp_path / "done"), []

    def job(key):
        if key == "b" and len(seen) < 2:
            seen.append("failed")
            raise ValueError(key)
        seen.append(key)

    with pytest.raises(ValueError):
        sinks.run_once(spark, ["a", "b", "c"], path, job)
    assert sinks.run_once(spark, ["a", "b", "c"], path, job) == ["b", "c"]
    assert sinks.run_once(spark, ["a", "b", "c"], path, job) == []
