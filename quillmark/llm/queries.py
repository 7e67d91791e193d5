"""Registered queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.cutoffs import submission_cutoffs
from quillmark.llm.groups import linked_groups
from quillmark.llm.leaks import leaking_documents
from quillmark.llm.mixing import mixed, shares
from quillmark.llm.pii import personal_data, redacted_texts
from quillmark.llm.setpairs import submission_pairs
from quillmark.llm.stuffing import stuffed_documents
from quillmark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "drafts"), table(spark, sf_dir, "vision"))


def p1_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_texts(table(spark, sf_dir, "drafts"), table(spark, sf_dir, "vision"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission_pairs(table(spark, sf_dir, "assets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(table(spark, sf_dir, "advanced_pairs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission_cutoffs(table(spark, sf_dir, "submissions"), table(spark, sf_dir, "class_targets"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mixed(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_redact, p2_found, p3_found, p4_found, p6_found, p7_mix, p7_shares, p8_found)
}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) != "＇") + "　"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c) != "＇") + " "


def _narrow(column: str) -> str:
    return f"translate({column}, '{_WIDE}', '{_PLAIN}')"


SQL = {
    "p2_found": r"""
with v as (
  select distinct 'object_id' f, work_answer_id w, lower(regexp_replace(object_id, '^\s+|\s+$', '', 'g')) x from assets where ok and work_answer_id is not null
  union select 'sha256', work_answer_id, lower(regexp_replace(sha256, '^\s+|\s+$', '', 'g')) from assets where ok and work_answer_id is not null),
r as (select * from v where x <> '' and not regexp_full_match(x, 'image_[0-9]+')),
z as (select f, w, count(*) n from r group by 1, 2 having count(*) >= 3),
k as (select r.*, n from r join z using (f, w)),
p as (select a.f, a.w a, b.w b, count(*) shared, a.n na, b.n nb from k a join k b on a.f = b.f and a.x = b.x and a.w < b.w group by a.f, a.w, b.w, a.n, b.n)
select f field_name, a a_work_answer_id, b b_work_answer_id from p where shared / (na + nb - shared) >= 0.6 - 1e-12
""",
    "p3_found": r"""
with recursive pieces as (
  select regexp_replace(a_work_answer_id, '^\s+|\s+$', '', 'g') a, regexp_replace(b_work_answer_id, '^\s+|\s+$', '', 'g') b
  from advanced_pairs
  where len(list_filter(string_split(exact_shared, ';'),
        lambda x: trim(x) <> '' and not regexp_full_match(lower(trim(x)), 'image_[0-9]+'))) > 0),
links as (select distinct a, b from pieces where a <> b and a <> '' and b <> ''),
edges as (select a, b from links union select b, a from links),
reach(work_answer_id, other) as (
  select a, b from edges
  union
  select r.work_answer_id, e.b from reach r join edges e on r.other = e.a)
select work_answer_id, least(work_answer_id, min(other)) as group_id from reach group by work_answer_id
""",
    "p6_found": rf"""
with d as (select doc_id, regexp_replace(lower({_narrow("text")}), '[^\p{{L}}\p{{N}}]+', '', 'g') t from documents),
w as (select item_id, lang, regexp_split_to_array(trim(regexp_replace(lower({_narrow("passage")}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') x from eval_items),
r as (
  select item_id, list_transform(range(1, len(x) - 10), lambda i: array_to_string(x[i:i + 11], '')) runs from w where lang = 'en'
  union all
  select item_id, list_transform(range(1, length(array_to_string(x, '')) - 22), lambda i: substr(array_to_string(x, ''), i, 24)) from w where lang = 'zh'),
u as (select item_id, unnest(runs) run from r)
select distinct doc_id, item_id from d, u where contains(t, run)
""",
}
