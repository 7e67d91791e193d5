"""Operators over the whole of their input, where a cut would show."""

from __future__ import annotations

from quillmark.plans import registry


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


ASSETS = "work_answer_id string, ok boolean, object_id string, src string, sha256 string, ahash string"


def shared_assets(spark, folder):
    """Six of 100 submissions share a file, three an id; thirty share a file that is common."""
    rows = [(f"w{i:02}", True, f"id{i}", "", f"own{i}", f"{i:064b}") for i in range(100)]
    rows += [(f"w{i:02}", True, f"x{i}", "", "SIX ", "1" * 64) for i in range(6)]
    rows += [(f"w{i:02}", True, "three", "", None, None) for i in range(10, 13)]
    rows += [(f"w{i:02}", True, "three" if i < 60 else f"y{i}", "", "thirty", "0" * 64) for i in range(50, 80)]
    return written(spark, folder, assets=(rows, ASSETS), submissions=([(f"w{i:02}",) for i in range(120)], "work_answer_id string"), advanced_pairs=([("w00", "w01"), ("w50", "w51")], "a_work_answer_id string, b_work_answer_id string"))


def test_shared_files_under_a_fifth_stay(spark, tmp_path):
    sf = shared_assets(spark, tmp_path)
    members = {(r["kind"], r["value"], r["records"]) for r in registry.QUERIES["exact_members"](spark, sf).collect()}
    assert members == {("file", "six", 6), ("object", "three", 3)}
    links = {r["work_answer_id"]: (r["objects"], r["object_links"], r["files"], r["file_links"]) for r in registry.QUERIES["exact_links"](spark, sf).collect()}
    assert len(links) == 100
    assert links["w00"] == (2, 0, 2, 5) and links["w10"] == (2, 2, 1, 0) and links["w50"] == (1, 0, 1, 0)


def test_likeness_keeps_codes_under_a_fifth(spark, tmp_path):
    sf = shared_assets(spark, tmp_path)
    best = {(r["a"], r["b"]): r["best"] for r in registry.QUERIES["image_likeness_whole"](spark, sf).collect()}
    assert best[("w00", "w01")] == 1.0 and best[("w50", "w51")] < 1.0


def test_all_drafts_are_decoded(spark, tmp_path):
    said = ["a comment in a single line", "two lines of it\nwith a Chinese 字 amid", "证据完整，步骤齐全，可以复现", "short", "", None]
    sf = written(spark, tmp_path, drafts=(list(enumerate(said)), "draft_id long, basis string"))
    got = {r["draft_id"]: r["decoded"] for r in registry.QUERIES["decoded_whole"](spark, sf).collect()}
    # By hand: what is mostly no ASCII, or under 18 bytes, isn't taken for a decoded text.
    assert got == {0: said[0], 1: said[1], 2: "", 3: "", 4: "", 5: ""}


def test_every_status_has_a_column(spark, tmp_path):
    statuses = ["已完成", "已批", "待批阅", "批阅", "重做待批阅", "new one", None]
    drafts = [(i, f"w{i}", s, float(i), "c", f"n{i}", f"s{i}") for i, s in enumerate(statuses)]
    subs = [(f"w{i}", "a", None, i) for i in range(len(statuses))]
    sf = written(
        spark,
        tmp_path,
        drafts=(drafts, "draft_id long, work_answer_id string, status string, draft_score double, class_name string, student_no string, student_name string"),
        submissions=(subs, "work_answer_id string, assignment_id string, collected_at timestamp, submit_row long"),
    )
    r = registry.QUERIES["score_pivot_whole"](spark, sf).first()
    assert r.asDict() == {"cls": "c", "done": 0.0, "marked": 1.0, "waiting": 2.0, "marking": 3.0, "redo": 4.0, "other": 6.0}


def test_evidence_of_all_texts_and_patterns(spark, tmp_path):
    vision = [(1, "a", "/rce.x sqli", "ncat -lvp 4444", "apt install docker.io"), (2, "b", None, None, None)]
    subs = [(1, "a", "Command 'docker'\nnot found 10.0.0.1"), (2, "b", "在10.0.0.1, SQLi; ncat  -lvp 4444"), (3, "c", None)]
    sf = written(spark, tmp_path, vision=(vision, "vision_id long, work_answer_id string, extracted_text string, summary string, review_comment string"), submissions=(subs, "submit_row long, work_answer_id string, answer_text string"))
    got = {(r["token"], r["records"]) for r in registry.QUERIES["evidence_frequency_whole"](spark, sf).collect()}
    assert got == {("10.0.0.1", 2), ("sqli", 2), ("ncat -lvp 4444", 2)}
    pairs = [tuple(r) for r in registry.QUERIES["evidence_containment_whole"](spark, sf).collect()]
    assert pairs == [("a", "b", 3, 1.0)]
