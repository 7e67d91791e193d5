"""Timestamp texts against a brute-force reading with the standard library."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quillmark.operators.instants import extend_dictionary, normalise_instants, stamp_keys

UTC = dt.timezone.utc


def ms(*parts, zone="UTC", fold=0):
    t = dt.datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold)
    return int(t.timestamp()) * 1000 + t.microsecond // 1000


COLLECTED = dt.datetime(2025, 3, 10, tzinfo=UTC)
CASES = [
    ("2024-02-26 06:53:21", None, ms(2024, 2, 26, 6, 53, 21, zone="Asia/Shanghai")),
    ("2024-02-26 06:53", "Europe/Berlin", ms(2024, 2, 26, 6, 53, zone="Europe/Berlin")),
    ("2024/2/6 6:53", "America/New_York", ms(2024, 2, 6, 6, 53, zone="America/New_York")),
    ("2024.02.26 20:21", "Asia/Kolkata", ms(2024, 2, 26, 20, 21, zone="Asia/Kolkata")),
    ("2024年2月26日 下午10:35", None, ms(2024, 2, 26, 22, 35, zone="Asia/Shanghai")),
    ("2024年2月26日 上午12:05", None, ms(2024, 2, 26, 0, 5, zone="Asia/Shanghai")),
    ("2024年6月14日12时09分", None, ms(2024, 6, 14, 12, 9, zone="Asia/Shanghai")),
    ("２０２４－０２－２６ ２１：５９", None, ms(2024, 2, 26, 21, 59, zone="Asia/Shanghai")),
    ("提交时间：2024-02-25 09:38:00", None, ms(2024, 2, 25, 9, 38, zone="Asia/Shanghai")),
    ("2024-09-30 14:31:41（已提交）", None, ms(2024, 9, 30, 14, 31, 41, zone="Asia/Shanghai")),
    ("May 7, 2025 1:49 AM", "Europe/Berlin", ms(2025, 5, 7, 1, 49, zone="Europe/Berlin")),
    ("Dec 22, 2024 12:04 AM", None, ms(2024, 12, 22, 0, 4, zone="Asia/Shanghai")),
    ("Sep 4, 2024 12:33 PM", None, ms(2024, 9, 4, 12, 33, zone="Asia/Shanghai")),
    ("10-Mar-2024 03:21:11", "America/New_York", ms(2024, 3, 10, 3, 21, 11, zone="America/New_York")),
    ("Thu, 26 Sep 2024 17:43:18 +0800", None, ms(2024, 9, 26, 9, 43, 18)),
    ("2024-06-14T11:58:00 -04:00", None, ms(2024, 6, 14, 15, 58)),
    ("2024-02-25T02:51:03+03:30", None, ms(2024, 2, 24, 23, 21, 3)),
    ("2024-09-30T10:56:18-07:00", None, ms(2024, 9, 30, 17, 56, 18)),
    ("2025-11-14T05:22:18 GMT+8", "Europe/Berlin", ms(2025, 11, 13, 21, 22, 18)),
    ("2024-06-14 15:29:41 GMT", "Europe/Berlin", ms(2024, 6, 14, 15, 29, 41)),
    ("2025-10-26 02:19:05 CEST", None, ms(2025, 10, 26, 0, 19, 5)),
    ("2025-01-17 08:10:19 CET", None, ms(2025, 1, 17, 7, 10, 19)),
    ("2024-07-01 08:00:00 EST", None, ms(2024, 7, 1, 13, 0, 0)),
    ("2024-07-01 08:00:00 AEDT", None, ms(2024, 6, 30, 21, 0, 0)),
    ("20240516T033510Z", None, ms(2024, 5, 16, 3, 35, 10)),
    ("20251018T075224", None, ms(2025, 10, 18, 7, 52, 24, zone="Asia/Shanghai")),
    ("2024-02-26T04:15:18.389Z", None, ms(2024, 2, 26, 4, 15, 18, 389000)),
    ("2024-11-25T00:50:34.825955227", "Europe/Berlin", ms(2024, 11, 25, 0, 50, 34, 825000, zone="Europe/Berlin")),
    ("1720682759793", None, 1720682759793),
    ("1756125142", "Europe/Berlin", 1756125142000),
    # local times that occur twice are the first, skipped ones are read with the offset before
    ("2024-11-03 01:30:00", "America/New_York", ms(2024, 11, 3, 1, 30, zone="America/New_York", fold=0)),
    ("2024-10-27 02:30:00", "Europe/Berlin", ms(2024, 10, 27, 0, 30)),
    ("2024-03-10 02:30:00", "America/New_York", ms(2024, 3, 10, 7, 30)),
    ("2024-03-31 02:15", "Europe/Berlin", ms(2024, 3, 31, 1, 15)),
    ("2024-10-06 02:15", "Australia/Sydney", ms(2024, 10, 5, 16, 15)),
    # no year: the latest not after collection
    ("03-09 08:00", None, ms(2025, 3, 9, 8, 0, zone="Asia/Shanghai")),
    ("3/12 08:00:05", None, ms(2024, 3, 12, 8, 0, 5, zone="Asia/Shanghai")),
    ("03-10 08:00", "Asia/Shanghai", ms(2025, 3, 10, 8, 0, zone="Asia/Shanghai")),
    ("03-10 08:01", "Asia/Shanghai", ms(2024, 3, 10, 8, 1, zone="Asia/Shanghai")),
    ("02-29 10:00", None, ms(2024, 2, 29, 10, 0, zone="Asia/Shanghai")),
] + [
    (bad, None, None)
    for bad in (
        None, "", "  ", "--", "N/A", "刚刚", "昨天 18:20", "14:25", "10月8日", "2025-04-07", "2024-13-05 10:20", "2025-02-30 08:15:00",
        "11-31 09:40", "2024/9/18 25:61", "0000-00-00 00:00:00", "2025-06-31T10:00:00Z", "未提交", "12", "x" * 20000,
    )
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, z, COLLECTED) for i, (t, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string, z string, at timestamp")
    return {r["i"]: r["utc_ms"] for r in normalise_instants(df, "t", "z", "at").collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: str(CASES[i][0])[:30])
def test_case(found, i):
    assert found[i] == CASES[i][2]


def test_rows_and_columns_stay(spark):
    df = spark.createDataFrame([("2024-02-26 06:53:21", 1), ("2024-02-26 06:53:21", 1), (None, 2)], "t string, utc_ms int")
    out = normalise_instants(df, "t")
    assert out.columns == ["t", "utc_ms"] and out.count() == 3
    assert normalise_instants(df.limit(0), "t").count() == 0


def test_no_collection_time_gives_no_year(spark):
    df = spark.createDataFrame([("03-09 08:00",)], "t string")
    assert normalise_instants(df, "t").first()["utc_ms"] is None


def test_unknown_zone_gives_none(spark):
    df = spark.createDataFrame([("2024-03-09 08:00", "Mars/Base"), ("2024-03-09 08:00Z", "Mars/Base")], "t string, z string")
    assert sorted(r["utc_ms"] is None for r in normalise_instants(df, "t", "z").collect()) == [False, True]


def test_dictionary_grows(spark, tmp_path):
    path = str(tmp_path / "book")
    df = spark.createDataFrame([("2024-02-26 06:53:21",), ("1756125142",)], "t string")
    more = spark.createDataFrame([("2024-02-26 06:53:21",), ("2024-02-26 06:54",)], "t string")
    normalise_instants(df, "t", dictionary_path=path).count()
    assert spark.read.parquet(path).count() == 2
    assert normalise_instants(more, "t", dictionary_path=path).where("utc_ms is null").count() == 0
    assert spark.read.parquet(path).count() == 3
    keys = more.select(*stamp_keys(more, "t", None, None, "UTC"))
    assert extend_dictionary(keys, path).where(F.col("stamp_zone") == "UTC").count() == 2


def test_four_digits_that_are_no_year(spark):
    texts = ["03-09 08:00 +0800", "03-09 08:00:30.123456", "03-09 08:00:30.1234 UTC"]
    at = dt.datetime(2024, 5, 1, tzinfo=UTC)
    df = spark.createDataFrame([(t, at) for t in texts], "t string, at timestamp")
    got = {r["t"]: r["utc_ms"] for r in normalise_instants(df, "t", None, "at").collect()}
    midnight = ms(2024, 3, 9)
    assert [got[t] - midnight for t in texts] == [0, 30_123, 8 * 3_600_000 + 30_123]
