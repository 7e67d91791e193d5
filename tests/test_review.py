"""Queries over reviewed pairs that have no SQL, and the path and rubric functions, against plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillmark.functions import extract, scalars
from quillmark.plans import registry

PAIR = "a_work_answer_id string, b_work_answer_id string, verdict string, exact_object boolean, exact_file boolean, exact_shared string, evidence_similarity double, sift_inliers int, akaze_inliers int"
SUBS = "submit_row long, work_answer_id string, student_no string, submit_time string, campus_tz string, assignment_id string"
TIMES = {"a": "2024-03-01 10:00", "b": "2024-03-01 09:00 +0000", "c": "2024-03-01 09:00 +0000", "d": "刚刚", "e": "1709200000", "f": "2024/3/2 下午3:00"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("review")
    subs = [(i, w, f"s{9 - i}", t, "UTC", "x") for i, (w, t) in enumerate(TIMES.items())] + [(90, "a", None, "2024-03-01 10:00", None, "x")]
    spark.createDataFrame(subs, SUBS).withColumn("collected_at", F.lit("2024-06-01").cast("timestamp")).write.parquet(f"{folder}/submissions.parquet")
    pairs = [(" b", "a", "confirmed", False, False, "", 0.5, 1, 1), ("a", "c", "confirmed", None, None, None, 0.9, None, 5), ("c", "b", "confirmed", True, False, " ", 0.1, 0, 0), ("d", "a", "confirmed", False, False, "x", 0.2, 0, 0), ("e", "f", "suspected", False, False, "", 0.9, 0, 0), ("f", "f", "confirmed", True, True, "x", 1.0, 0, 0), ("f", "gone", "confirmed", False, False, "", 1.0, 0, 0)]
    spark.createDataFrame(pairs, PAIR).write.parquet(f"{folder}/advanced_pairs.parquet")
    drafts = [(i, w, 60.0 + i, "X", f"s{i}", f"n{i}", "已批") for i, w in enumerate(TIMES)]
    spark.createDataFrame(drafts, "draft_id long, work_answer_id string, draft_score double, class_name string, student_no string, student_name string, status string").write.parquet(f"{folder}/drafts.parquet")
    return str(folder)


# By hand: the instants in order are d (none: 0), e, b and c (equal), a (10:00 in Shanghai is 02:00 UTC), f.
ORDER = ["d", "e", "a", "b", "c", "f"]


def test_direct_sources(spark, sf):
    got = {r["work_answer_id"]: r["source"] for r in registry.QUERIES["direct_sources"](spark, sf).collect()}
    # a: only d is earlier; b: partners a (earlier) and c (equal); c: a and b; d has none earlier.
    assert got == {"a": "d", "b": "a", "c": "a"}


def test_later_of_pairs(spark, sf):
    got = {(r["first"], r["later"]): r["hard"] for r in registry.QUERIES["later_of_pairs"](spark, sf).collect()}
    # b and c tie by instant: the smaller student number is first (s7 of c, s8 of b).
    assert got == {("a", "b"): False, ("a", "c"): False, ("c", "b"): True, ("d", "a"): True}


def test_submit_positions(spark, sf):
    got = {r["work_answer_id"]: r["position"] for r in registry.QUERIES["submit_positions"](spark, sf).collect()}
    assert got == {"d": 1, "e": 2, "a": 3, "c": 4, "b": 5, "f": 6}


def test_collation(spark, tmp_path):
    names = [("乙班", "张", "1"), ("甲班", "李", "2"), ("甲班", "阿", "3"), ("乙班", "白", None)]
    spark.createDataFrame(names, "class_name string, student_name string, student_no string").write.parquet(f"{tmp_path}/drafts.parquet")
    got = {r["place"]: r["student_name"] for r in registry.QUERIES["student_order"](spark, str(tmp_path)).collect()}
    # by sound: jia before yi; a before li, bai before zhang
    assert [got[i] for i in (1, 2, 3, 4)] == ["阿", "李", "白", "张"]


def one(spark, value, column, no="2021031638"):
    return spark.createDataFrame([(value, no)], "x string, no string").select(column.alias("y")).first()["y"]


def test_paths(spark):
    x = F.col("x")
    assert one(spark, "见 h t t p://10.0.0 5 : 8080 v exmonine/shel1_38.jsp，好", extract.paths_in(x))[0].startswith("http://10.0.0.5:8080/")
    assert one(spark, "http://10.0.0.5:8080/upload/a.jsp); www http:", extract.paths_in(x)) == ["http://10.0.0.5:8080/upload/a.jsp", "10.0.0.5:8080/upload/a.jsp", "/upload/a.jsp"]
    assert one(spark, "apache.org/x tomcat-9 /upload/css", extract.paths_in(x)) == []
    assert one(spark, None, extract.paths_in(x)) == []
    assert one(spark, "exam0nlinex.jsp)", extract.repaired_path(x)) == "/examonline/x.jsp" and one(spark, "httpi10.0.0.1:80vexam", extract.repaired_path(x)) == "http://10.0.0.1:80/exam"
    assert len(one(spark, " ".join(f"http://a.b/{i}" for i in range(50)), extract.paths_in(x))) == 20


def test_shell_pieces(spark):
    x, no = F.col("x"), F.col("no")
    assert one(spark, "SHELL.jsp 和 shell_38.jsp /upload/a.txt, http://a.b/none", extract.shell_pieces(x)) == ["/upload/a.txt,", "shell.jsp", "shell_38.jsp"]
    for piece, strong in (("shell.jsp", False), ("shell_38.jsp", True), ("hack38", True), ("hack3", False), ("http://a/2021031638", True), ("memshell.jsp", True), ("/examonline/abcd.jsp", True), ("/examonline/ab", False), ("wx", False), ("", False)):
        assert one(spark, piece, extract.strong_piece(x, no)) is strong, piece
    assert one(spark, "hack38", extract.strong_piece(x, no), None) is False
    assert one(spark, "hack.+", extract.strong_piece(x, no), "a.+") is True  # the digits are taken literally


def brute_rubric(text):
    picked = []
    for line in [s.strip() for s in re.split(r"\r?\n", text or "") if s.strip()]:
        if re.search(extract.RUBRIC_WORDS, line, re.I) or len(picked) < 20:
            picked.append(line)
        if len("\n".join(picked)) > 9000:
            break
    return picked


@pytest.mark.parametrize("text", ["", None, "a\n\n b \r\nc", "\n".join(f"line {i}" for i in range(40)) + "\nPAYLOAD here\nlast", "\n".join(f"漏洞 {i} " + "x" * 400 for i in range(60)), "y" * 9500 + "\nsql\nz"])
def test_rubric(spark, text):
    assert one(spark, text, extract.rubric_lines(F.col("x"))) == brute_rubric(text)


def test_form_fields_and_metric(spark):
    rows = [([("answer1", "x"), ("score2", "88")], "5"), ([("score", "1")], "5"), ([], None), ([("score3", "")], "7")]
    df = spark.createDataFrame(rows, "f array<struct<name:string,value:string>>, old string")
    assert [r["s"] for r in df.select(extract.form_score(F.col("f"), F.col("old")).alias("s")).collect()] == ["88", "5", "", "7"]
    nums = spark.createDataFrame([(0.5,), (1.0,), (0.12345,), (None,), (100.0,)], "x double")
    assert [r["m"] for r in nums.select(scalars.metric("x").alias("m")).collect()] == ["0.5", "1", "0.1235", "", "100"]
