"""Registered queries of sources, sinks and streams: what goes out comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import rows
from quillmark.session import scratch_path
from quillmark.sources import readers, sinks
from quillmark.sources.tables import table
from quillmark.streaming.reviews import daily_counts, first_seen, open_sessions


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts written as CSV and read again: sums, flags and the length of the texts by class."""
    d = table(spark, sf_dir, "drafts").select("draft_id", "approved", "class_name", "draft_score", "draft_comment")
    path = scratch_path(spark, "csv")
    sinks.write_csv(d, path)
    back = readers.read_csv(spark, path, d.schema)
    return back.groupBy(F.coalesce(F.lower(F.trim("class_name")), F.lit("")).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("approved").alias("approved"), F.sum((F.col("draft_score") * 10).cast("long")).alias("tenths"), F.sum(F.length("draft_comment")).alias("chars")
    )


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vision results written as JSON with every hundredth line broken, read tolerantly: good and broken rows by model."""
    v = table(spark, sf_dir, "vision").select("vision_id", "model_name", "score", "missing_items")
    path = scratch_path(spark, "json")
    line = F.to_json(F.struct(*v.columns))
    v.select(F.when(F.col("vision_id") % 100 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")).write.text(path)
    back = readers.read_json(spark, path, v.schema)
    bad = F.col("_corrupt").isNotNull()
    back = back.select("model_name", "score", "missing_items", bad.alias("bad"))
    return back.groupBy(F.when(F.col("bad"), "broken").otherwise(F.coalesce("model_name", F.lit("none"))).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("bad"), F.col("score"))).alias("score"), F.sum(F.when(~F.col("bad"), F.size("missing_items"))).cast("long").alias("missing"))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts written as JSON by status, one folder after the other, and read again: the last file wins for each submission."""
    d = table(spark, sf_dir, "drafts").where("work_answer_id is not null").select("work_answer_id", "draft_id", "draft_score", "status", "draft_comment")
    path = scratch_path(spark, "json-files")
    for n, part in enumerate((d.where("draft_id % 2 = 0"), d.where("draft_id % 2 = 1"))):
        one = rows.last_by(part, ["work_answer_id"], ["draft_id"])
        sinks.write_json(one, f"{path}/run-{n}")
    back = readers.read_json_files(spark, f"{path}/run-*", d.schema, "work_answer_id")
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("draft_id").alias("ids"), F.sum(F.length("draft_comment")).alias("chars"))


def outbox_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that may be sent, by status."""
    return sinks.outbox(table(spark, sf_dir, "drafts")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("work_answer_id").alias("submissions"))


QUERIES = {"csv_round_trip": csv_round_trip, "json_round_trip": json_round_trip, "json_files": json_files, "outbox_counts": outbox_counts, "stream_first_seen": first_seen, "stream_daily_counts": daily_counts, "stream_sessions": open_sessions}

SQL = {
    "csv_round_trip": """
select coalesce(lower(trim(class_name)), '') cls, count(*) n, count(*) filter (approved) approved, sum(trunc(draft_score * 10)::bigint)::bigint tenths,
  sum(length(coalesce(draft_comment, '')))::bigint chars from drafts group by 1""",
    "json_round_trip": """
select case when vision_id % 100 = 0 then 'broken' else coalesce(model_name, 'none') end model, count(*) n,
  sum(case when vision_id % 100 <> 0 then score end)::bigint score, sum(case when vision_id % 100 <> 0 then len(missing_items) end)::bigint missing from vision group by 1""",
    "json_files": """
with d as (select * from drafts where work_answer_id is not null qualify row_number() over (partition by work_answer_id order by draft_id % 2 desc, draft_id desc) = 1)
select status, count(*) n, sum(draft_id)::bigint ids, sum(length(draft_comment))::bigint chars from d group by 1""",
    "outbox_counts": """
select status, count(*) n, count(distinct work_answer_id) submissions from drafts
where not coalesce(skipped, false) and coalesce(review_url, '') <> '' and not coalesce(regexp_matches(status, '已完成|已批'), false) and approved and draft_score > 0 group by 1""",
    "stream_first_seen": "select assignment_id, count(distinct work_answer_id) submissions from submissions group by 1",
    "stream_daily_counts": "select strftime(collected_at at time zone 'UTC', '%Y-%m-%d') as \"day\", status, count(*) n from submissions group by 1, 2",
    "stream_sessions": """
with r as (select student_no, collected_at t, case when collected_at - lag(collected_at) over (partition by student_no order by collected_at) < interval 7 days then 0 else 1 end s
  from submissions where student_no <> ''),
g as (select student_no, t, sum(s) over (partition by student_no order by t rows unbounded preceding) k from r)
select student_no, epoch_ms(min(t)) start_ms, count(*) n from g group by student_no, k""",
}
