"""Registered queries: ranking, grouping and summarising of drafts and submissions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.scalars import chinese_number, clamp, first_filled, half_up, leading_number, number
from quillmark.operators import rows
from quillmark.sources.tables import table

NO_CLASS = "未分班"


def latest_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last draft of each submission, with the assignment and time of its last collection (null for a draft
    without a submission), its class and score."""
    drafts = rows.last_by(table(spark, sf_dir, "drafts").where("work_answer_id is not null"), ["work_answer_id"], ["draft_id"])
    subs = rows.last_by(table(spark, sf_dir, "submissions"), ["work_answer_id"], ["submit_row"])
    subs = subs.select("work_answer_id", "assignment_id", "collected_at", "submit_row")
    cls = F.coalesce(F.nullif(F.lower(F.trim("class_name")), F.lit("")), F.lit(NO_CLASS))
    student = first_filled(F.col("student_no"), F.col("student_name"), F.col("work_answer_id"))
    return drafts.join(subs, "work_answer_id", "left").withColumns({"cls": cls, "student": student, "score": F.coalesce("draft_score", F.lit(0.0))})


_LATEST = """
latest as (
  select d.*, s.assignment_id, s.collected_at, s.submit_row,
    coalesce(nullif(lower(trim(d.class_name)), ''), '未分班') cls,
    coalesce(nullif(d.student_no, ''), nullif(d.student_name, ''), d.work_answer_id) student,
    coalesce(d.draft_score, 0.0) score
  from (select * from drafts where work_answer_id is not null
        qualify row_number() over (partition by work_answer_id order by draft_id desc) = 1) d
  left join (select * from submissions qualify row_number() over (partition by work_answer_id order by submit_row desc) = 1) s
  using (work_answer_id))
"""


def class_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each student, one draft for each assignment (the last), ranked in the class by rounded total."""
    last = rows.last_by(latest_drafts(spark, sf_dir).select("cls", "student", "assignment_id", "score", "submit_row"), ["cls", "student", "assignment_id"], ["submit_row"])
    per = last.groupBy("cls", "student").agg(
        half_up(F.sum("score"), 2).alias("total"),
        half_up(F.avg("score"), 2).alias("average"),
        F.count(F.lit(1)).alias("submitted"),
        F.count_if(F.col("score") == 0).alias("zeros"),
    )
    return rows.competition_rank(per, ["cls"], F.col("total"), "place")


def accumulated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over every row, repeated ones too, with the mean over the class's assignments."""
    d = latest_drafts(spark, sf_dir)
    n = d.groupBy("cls").agg(F.countDistinct("assignment_id").alias("assignments"))
    per = d.groupBy("cls", "student").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("submitted"))
    out = per.join(n, "cls")
    return out.select(
        "cls",
        "student",
        half_up(F.col("total"), 2).alias("total"),
        half_up(F.col("total") / F.greatest("assignments", F.lit(1)), 2).alias("mean"),
        F.greatest(F.lit(0), F.col("assignments") - F.col("submitted")).alias("missing"),
    )


def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students, mean total and zeros by class, and over all classes."""
    d = latest_drafts(spark, sf_dir)
    per = d.groupBy("cls", "student").agg(F.sum("score").alias("total"), F.count_if(F.col("score") == 0).alias("zeros"))
    both = per.rollup("cls").agg(F.count(F.lit(1)).alias("students"), half_up(F.avg("total"), 2).alias("mean_total"), F.sum("zeros").alias("zeros"))
    return both.withColumn("cls", F.coalesce("cls", F.lit("*")))


def position_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of collection within assignment and class among scored drafts, as position and share of the group."""
    d = latest_drafts(spark, sf_dir).where("score > 0").select("work_answer_id", "assignment_id", "cls", "collected_at", "submit_row")
    out = rows.position_share(d, ["assignment_id", "cls"], ["collected_at", "submit_row"])
    return out.select("work_answer_id", "assignment_id", "cls", F.col("position").cast("long").alias("position"), half_up(F.col("share"), 6).alias("share"))


def assignment_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by score within assignment and class."""
    d = latest_drafts(spark, sf_dir).select("work_answer_id", "assignment_id", "cls", "score")
    return rows.competition_rank(d, ["assignment_id", "cls"], F.col("score"), "place")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many drafts of each class have each score, as one text by rising score."""
    d = table(spark, sf_dir, "drafts").where("draft_score is not null")
    cls = F.coalesce(F.nullif(F.lower(F.trim("class_name")), F.lit("")), F.lit(NO_CLASS))
    n = d.groupBy(cls.alias("cls"), "draft_score").agg(F.count(F.lit(1)).alias("n"))
    # At most as many scores a class as there are distinct scores.
    parts = F.array_sort(F.collect_list(F.struct("draft_score", "n")))
    text = F.array_join(F.transform(parts, lambda x: F.concat(half_up(x["draft_score"] * 10).cast("long").cast("string"), F.lit(": "), x["n"].cast("string"))), " / ")
    return n.groupBy("cls").agg(text.alias("histogram"), F.sum("n").alias("drafts"))


def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the highest scores by class, a column for each status."""
    d = latest_drafts(spark, sf_dir).groupBy("cls").pivot("status", ["已完成", "已批", "待批阅", "批阅"]).agg(F.max("score"))
    return d.toDF("cls", "done", "marked", "waiting", "marking")


def score_pivot_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest scores by class, a column for each known status and one for all others, so that every draft counts."""
    names = {"已完成": "done", "已批": "marked", "待批阅": "waiting", "批阅": "marking", "重做待批阅": "redo"}
    column = F.lit("other")
    for status, name in names.items():
        column = F.when(F.col("status") == status, name).otherwise(column)
    d = latest_drafts(spark, sf_dir).withColumn("column", column)
    return d.groupBy("cls").pivot("column", [*names.values(), "other"]).agg(F.max("score"))


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each student's scores by assignment as one text, in the order of the assignments' numerals."""
    last = rows.last_by(latest_drafts(spark, sf_dir).select("cls", "student", "assignment_id", "score", "submit_row"), ["cls", "student", "assignment_id"], ["submit_row"])
    names = table(spark, sf_dir, "assignments").select("assignment_id", "title", "assignment_key")
    numeral = F.regexp_extract("title", "([一二三四五六七八九十]+)", 1)
    names = names.withColumn("at", chinese_number(numeral))
    # A student has at most as many rows as there are assignments.
    parts = F.array_sort(F.collect_list(F.struct("at", "assignment_id", "assignment_key", "score")))
    line = F.array_join(F.transform(parts, lambda x: F.concat(x["assignment_key"], F.lit(":"), (x["score"] * 10).cast("long").cast("string"))), " | ")
    return last.join(names, "assignment_id").groupBy("cls", "student").agg(line.alias("scores"))


def calibration_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed drafts as examples: of each score the three with the most images, from the highest score down,
    fourteen in all."""
    n = table(spark, sf_dir, "assets").groupBy("work_answer_id").agg(F.count(F.lit(1)).alias("images"))
    d = latest_drafts(spark, sf_dir).where(rows.completed(F.col("status"))).join(n, "work_answer_id", "left").na.fill(0, ["images"])
    three = rows.top_k(d, ["score"], [F.desc("images"), F.col("draft_id")], 3)
    return three.orderBy(F.desc("score"), "place").limit(14).select("draft_id", "score", "images", F.col("place").cast("long").alias("place"))


def draft_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts by assignment: drafts, done, waiting, zero, approved, skipped; and whether all have a submission."""
    d = latest_drafts(spark, sf_dir)
    counts = d.groupBy("assignment_id").agg(
        F.count(F.lit(1)).alias("drafts"),
        F.count_if(rows.completed(F.col("status"))).alias("done"),
        F.count_if(rows.pending(F.col("status"))).alias("waiting"),
        F.count_if(F.col("score") == 0).alias("zeros"),
        F.count_if(F.col("approved")).alias("approved"),
        F.count_if(F.col("skipped")).alias("skipped"),
    )
    subs = table(spark, sf_dir, "submissions").groupBy("assignment_id").agg(F.countDistinct("work_answer_id").alias("submissions"))
    out = subs.join(counts, "assignment_id", "left").na.fill(0)
    return out.withColumn("complete", (F.col("submissions") > 0) & (F.col("submissions") == F.col("drafts")))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "submissions")
    return s.groupBy("assignment_id", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("work_answer_id").alias("submissions"))


def score_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loose readings of existing_score: as number, as leading number, clamped; counted."""
    s = table(spark, sf_dir, "submissions").select("existing_score")
    n = s.groupBy("existing_score").agg(F.count(F.lit(1)).alias("n"))
    x = F.col("existing_score")
    return n.select(x, "n", number(x).alias("as_number"), leading_number(x).alias("leading"), clamp(number(x) * 1.1, 100).alias("clamped"))


def last_filled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last name and class that each student number was seen with, blanks left out."""
    s = table(spark, sf_dir, "submissions").where("student_no is not null and student_no <> ''")

    def last(c: str):
        return F.max_by(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col("submit_row"))).alias(c)

    return s.groupBy("student_no").agg(last("student_name"), last("class_name"), F.count(F.lit(1)).alias("seen"))


def assignment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the assignments by the Chinese numeral in their titles, with their submissions."""
    a = table(spark, sf_dir, "assignments").withColumn("at", chinese_number(F.regexp_extract("title", "([一二三四五六七八九十]+)", 1)))
    n = table(spark, sf_dir, "submissions").groupBy("assignment_id").agg(F.count(F.lit(1)).alias("submissions"))
    return a.join(n, "assignment_id", "left").select("assignment_id", "title", "at", F.coalesce("submissions", F.lit(0)).alias("submissions"))


def selected_submissions(spark: SparkSession, sf_dir: str, selection: str = "assignment-3, 作业五; runs/assignment-7") -> DataFrame:
    """Submissions of the assignments named in an option text by key, title or folder; all where it names none."""
    wanted = [w for w in re.split(r"[,;\s]+", selection) if w]
    a = table(spark, sf_dir, "assignments")
    hit = F.col("assignment_key").isin(wanted) | F.col("title").isin(wanted) | F.col("run_dir").isin(wanted)
    hit = hit | F.exists(F.split("title", " "), lambda x: x.isin(wanted))
    kept = a.where(hit) if wanted else a
    s = table(spark, sf_dir, "submissions").join(kept.select("assignment_id", "assignment_key"), "assignment_id")
    return s.groupBy("assignment_key").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("work_answer_id").alias("submissions"))


QUERIES = {
    f.__name__: f
    for f in (
        class_rank,
        accumulated_totals,
        class_summary,
        position_shares,
        assignment_rank,
        score_histogram,
        score_pivot,
        score_pivot_whole,
        score_lines,
        calibration_examples,
        draft_counts,
        status_counts,
        score_parsing,
        last_filled_names,
        assignment_order,
        selected_submissions,
    )
}

_NUMERAL = """
numerals(c, n) as (select substr('一二三四五六七八九', i, 1), i from range(1, 10) t(i)),
numeral as (
  select a.*, regexp_extract(title, '([一二三四五六七八九十]+)', 1) z,
    coalesce(case when z like '%十%' then
        (case when split_part(z, '十', 1) = '' then 1 else (select n from numerals where c = split_part(z, '十', 1)) end) * 10
        + (case when split_part(z, '十', 2) = '' then 0 else (select n from numerals where c = split_part(z, '十', 2)) end)
      else (select n from numerals where c = z) end, 999)::int as "at"
  from assignments a)
"""

SQL = {
    "class_rank": f"""
with {_LATEST}, one as (select * from latest qualify row_number() over (partition by cls, student, assignment_id order by submit_row desc) = 1),
per as (select cls, student, floor(sum(score) * 100 + 0.5) / 100 total, floor(avg(score) * 100 + 0.5) / 100 average,
  count(*) submitted, count(*) filter (score = 0) zeros from one group by 1, 2)
select *, rank() over (partition by cls order by total desc)::int place from per""",
    "accumulated_totals": f"""
with {_LATEST}, n as (select cls, count(distinct assignment_id) assignments from latest group by 1),
per as (select cls, student, sum(score) total, count(*) submitted from latest group by 1, 2)
select cls, student, floor(total * 100 + 0.5) / 100 total, floor(total / greatest(assignments, 1) * 100 + 0.5) / 100 mean,
  greatest(0, assignments - submitted) missing from per join n using (cls)""",
    "class_summary": f"""
with {_LATEST}, per as (select cls, student, sum(score) total, count(*) filter (score = 0) zeros from latest group by 1, 2)
select coalesce(cls, '*') cls, count(*) students, floor(avg(total) * 100 + 0.5) / 100 mean_total, sum(zeros)::bigint zeros
from per group by rollup (cls)""",
    "position_shares": f"""
with {_LATEST}, d as (select * from latest where score > 0)
select work_answer_id, assignment_id, cls, row_number() over w as "position",
  floor(row_number() over w / count(*) over (partition by assignment_id, cls) * 1000000 + 0.5) / 1000000 as "share"
from d window w as (partition by assignment_id, cls order by collected_at, submit_row)""",
    "assignment_rank": f"""
with {_LATEST} select work_answer_id, assignment_id, cls, score, rank() over (partition by assignment_id, cls order by score desc)::int place from latest""",
    "score_histogram": """
with n as (select coalesce(nullif(lower(trim(class_name)), ''), '未分班') cls, draft_score, count(*) n from drafts where draft_score is not null group by 1, 2)
select cls, string_agg(floor(draft_score * 10 + 0.5)::bigint::varchar || ': ' || n::varchar, ' / ' order by draft_score) histogram, sum(n)::bigint drafts
from n group by 1""",
    "score_pivot": f"""
with {_LATEST} select cls, max(score) filter (status = '已完成') done, max(score) filter (status = '已批') marked,
  max(score) filter (status = '待批阅') waiting, max(score) filter (status = '批阅') marking from latest group by 1""",
    "score_pivot_whole": f"""
with {_LATEST} select cls, max(score) filter (status = '已完成') done, max(score) filter (status = '已批') marked,
  max(score) filter (status = '待批阅') waiting, max(score) filter (status = '批阅') marking, max(score) filter (status = '重做待批阅') redo,
  max(score) filter (coalesce(status, '') not in ('已完成', '已批', '待批阅', '批阅', '重做待批阅')) other from latest group by 1""",
    "score_lines": f"""
with {_LATEST}, {_NUMERAL}, one as (select * from latest qualify row_number() over (partition by cls, student, assignment_id order by submit_row desc) = 1)
select cls, student, string_agg(assignment_key || ':' || trunc(score * 10)::bigint::varchar, ' | ' order by "at", assignment_id) scores
from one join numeral using (assignment_id) group by 1, 2""",
    "calibration_examples": f"""
with {_LATEST}, n as (select work_answer_id, count(*) images from assets group by 1),
three as (select draft_id, score, coalesce(images, 0) images, row_number() over (partition by score order by coalesce(images, 0) desc, draft_id) place
  from latest left join n using (work_answer_id) where regexp_matches(status, '已完成|已批') qualify place <= 3)
select * from three order by score desc, place limit 14""",
    "draft_counts": f"""
with {_LATEST}, c as (select assignment_id, count(*) drafts, count(*) filter (regexp_matches(status, '已完成|已批')) done,
  count(*) filter (regexp_matches(status, '待批阅|重做待批阅|批阅') and not regexp_matches(status, '已完成|已批|查看')) waiting,
  count(*) filter (score = 0) zeros, count(*) filter (approved) approved, count(*) filter (skipped) skipped from latest group by 1),
s as (select assignment_id, count(distinct work_answer_id) submissions from submissions group by 1)
select assignment_id, submissions, coalesce(drafts, 0) drafts, coalesce(done, 0) done, coalesce(waiting, 0) waiting, coalesce(zeros, 0) zeros,
  coalesce(approved, 0) approved, coalesce(skipped, 0) skipped, submissions > 0 and submissions = coalesce(drafts, 0) complete
from s left join c using (assignment_id)""",
    "status_counts": "select assignment_id, status, count(*) n, count(distinct work_answer_id) submissions from submissions group by 1, 2",
    "score_parsing": r"""
with n as (select existing_score, count(*) n from submissions group by 1)
select existing_score, n, coalesce(try_cast(trim(existing_score) as double), 0.0) as_number,
  try_cast(nullif(regexp_extract(existing_score, '^\s*([-+]?(?:\d+\.?\d*|\.\d+))', 1), '') as double) as "leading",
  least(100.0, greatest(0.0, floor(coalesce(try_cast(trim(existing_score) as double), 0.0) * 1.1 + 0.5)))::double clamped from n""",
    "last_filled_names": """
select student_no, arg_max(student_name, submit_row) filter (trim(student_name) <> '') student_name,
  arg_max(class_name, submit_row) filter (trim(class_name) <> '') class_name, count(*) seen
from submissions where student_no is not null and student_no <> '' group by 1""",
    "assignment_order": f"""
with {_NUMERAL}, n as (select assignment_id, count(*) submissions from submissions group by 1)
select assignment_id, title, "at", coalesce(submissions, 0) submissions from numeral left join n using (assignment_id)""",
    "selected_submissions": """
select assignment_key, count(*) as "rows", count(distinct work_answer_id) submissions from submissions join assignments using (assignment_id)
where assignment_key in ('assignment-3') or run_dir in ('runs/assignment-7') or list_contains(string_split(title, ' '), '作业五') group by 1""",
}
