"""Registered queries over matched pairs of submissions: joins, groups, components, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.extract import REFERENCE_EVIDENCE, evidence_tokens, long_numbers, reference_tokens
from quillmark.functions.scalars import half_up
from quillmark.operators import rows
from quillmark.operators.common import common_values, without_common
from quillmark.operators.components import components
from quillmark.operators.similarity import average_hash, rare_containment_pairs, ratio_matches, text_pairs
from quillmark.session import scratch_path
from quillmark.sources.tables import table


def strength():
    """Evidence first, then the matched points."""
    return F.coalesce("evidence_similarity", F.lit(0.0)) * 100000 + F.coalesce("sift_inliers", F.lit(0)) + F.coalesce("akaze_inliers", F.lit(0))


def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each unordered pair of different ids: rows, the highest evidence, whether any was confirmed."""
    p = rows.with_pair_key(table(spark, sf_dir, "advanced_pairs"), "a_work_answer_id", "b_work_answer_id").where("low_id < high_id")
    return p.groupBy("low_id", "high_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("evidence_similarity").alias("evidence"),
        F.coalesce(F.bool_or(F.col("verdict") == "confirmed"), F.lit(False)).alias("confirmed"),
        F.countDistinct("verdict").alias("verdicts"),
    )


def pair_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs joined with the last submission of either side; same class and same assignment or not."""
    p = rows.with_pair_key(table(spark, sf_dir, "advanced_pairs"), "a_work_answer_id", "b_work_answer_id").where("low_id < high_id").select("low_id", "high_id").distinct()
    s = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row", "class_id", "assignment_id"), ["work_answer_id"], ["submit_row"])
    a = s.toDF("low_id", "row_a", "class_a", "asg_a")
    b = s.toDF("high_id", "row_b", "class_b", "asg_b")
    j = p.join(a, "low_id", "left").join(b, "high_id", "left")
    return j.select("low_id", "high_id", F.col("row_a"), F.col("row_b"), F.coalesce(F.col("class_a") == F.col("class_b"), F.lit(False)).alias("same_class"), F.coalesce(F.col("asg_a") == F.col("asg_b"), F.lit(False)).alias("same_assignment"))


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each submission its partners: how many, and how many by verdict."""
    p = rows.with_pair_key(table(spark, sf_dir, "advanced_pairs"), "a_work_answer_id", "b_work_answer_id").where("low_id < high_id")
    sides = rows.both_sides(p, "low_id", "high_id", "verdict")
    return sides.groupBy(F.col("me").alias("work_answer_id")).agg(
        F.countDistinct("other").alias("partners"),
        F.count_if(F.col("verdict") == "confirmed").alias("confirmed"),
        F.count_if(F.col("verdict") == "suspected").alias("suspected"),
    )


def strongest_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partner with the strongest evidence of each submission; ties go to the smaller id."""
    p = rows.with_pair_key(table(spark, sf_dir, "advanced_pairs"), "a_work_answer_id", "b_work_answer_id").where("low_id < high_id")
    sides = rows.both_sides(p.withColumn("strength", half_up(strength(), 4)), "low_id", "high_id", "strength")
    per = sides.groupBy("me", "other").agg(F.max("strength").alias("strength"))
    best = per.groupBy(F.col("me").alias("work_answer_id")).agg(F.min(F.struct((-F.col("strength")).alias("s"), "other")).alias("b"))
    return best.select("work_answer_id", F.col("b.other").alias("partner"), (-F.col("b.s")).alias("strength"))


def earliest_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the confirmed partners collected no later than a submission, the earliest; then the strongest, then the smaller id."""
    p = rows.with_pair_key(table(spark, sf_dir, "advanced_pairs"), "a_work_answer_id", "b_work_answer_id").where("low_id < high_id and verdict = 'confirmed'")
    sides = rows.both_sides(p.withColumn("strength", half_up(strength(), 4)), "low_id", "high_id", "strength")
    s = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row", "collected_at"), ["work_answer_id"], ["submit_row"])
    j = sides.join(s.toDF("me", "my_row", "my_at"), "me").join(s.toDF("other", "row", "at"), "other").where("at <= my_at")
    best = j.groupBy(F.col("me").alias("work_answer_id")).agg(F.min(F.struct("at", (-F.col("strength")).alias("s"), "other")).alias("b"))
    return best.select("work_answer_id", F.col("b.other").alias("source"), F.unix_millis("b.at").alias("source_ms"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by verdict and where it came from."""
    p = table(spark, sf_dir, "advanced_pairs")
    return p.groupBy("verdict", "verdict_source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("decision_reason").alias("reasons"))


def verdict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong or moderate agreement of features against the stored verdicts, counted.  The thresholds are fixed values."""
    z = lambda c: F.coalesce(c, F.lit(0))
    s = lambda n, r, k: (z("sift_inliers") >= n) & (z("sift_ratio") >= r) & (z("sift_coverage") >= k)
    a = lambda n, r, k: (z("akaze_inliers") >= n) & (z("akaze_ratio") >= r) & (z("akaze_coverage") >= k)
    ev, h = z("evidence_similarity"), z("image_hash_similarity")
    strong = s(300, 0.18, 0.45) | a(250, 0.18, 0.45)
    moderate = s(150, 0.08, 0) | a(120, 0.08, 0)
    ruled = (
        F.when(F.coalesce(F.col("exact_object") | F.col("exact_file"), F.lit(False)), "exact")
        .when((h >= 0.97) & s(500, 0.35, 0.45) & a(250, 0.18, 0.40), "image")
        .when(s(1500, 0.40, 0.75) & a(1500, 0.60, 0.50) & (ev >= 0.65), "local")
        .when(s(500, 0.24, 0.45) & a(400, 0.24, 0.42) & (ev >= 0.50), "region")
        .when(s(500, 0.35, 0.45) & (ev >= 0.35), "features")
        .when(strong & (ev >= 0.95), "evidence")
        .when(strong | (moderate & (ev >= 0.65)) | (ev >= 0.8), "suspected")
        .otherwise("none")
    )
    return table(spark, sf_dir, "advanced_pairs").groupBy(ruled.alias("ruled"), "verdict").agg(F.count(F.lit(1)).alias("n"))


def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions that share a real id, by id: how many, with how many pairs; two submissions at least."""
    p = table(spark, sf_dir, "advanced_pairs").withColumn("key", F.explode(F.split("exact_shared", ";"))).withColumn("key", F.trim("key"))
    p = p.where((F.col("key") != "") & ~F.lower("key").rlike(r"^image_\d+$"))
    sides = rows.both_sides(p.select(F.trim("a_work_answer_id").alias("a"), F.trim("b_work_answer_id").alias("b"), "key"), "a", "b", "key")
    return sides.groupBy("key").agg(F.countDistinct("me").alias("members"), (F.count(F.lit(1)) / 2).cast("long").alias("pairs")).where("members >= 2")


def first_of_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the confirmed pairs with their size and the member collected first."""
    p = rows.with_pair_key(table(spark, sf_dir, "advanced_pairs"), "a_work_answer_id", "b_work_answer_id").where("low_id < high_id and verdict = 'confirmed'")
    c = components(p, "low_id", "high_id")
    s = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row"), ["work_answer_id"], ["submit_row"])
    j = c.join(s.toDF("id", "row"), "id", "left")
    return j.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min_by("id", F.struct(F.coalesce("row", F.lit(2**62)), "id")).alias("first"))


def unmatched_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students and assignments of the drafts that have no submission under the same number, name and class."""
    key = ["student_no", "student_name", "class_key"]
    cls = F.coalesce(F.lower(F.trim("class_name")), F.lit("")).alias("class_key")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("student_no", "student_name")]
    d = table(spark, sf_dir, "drafts").select(*blank, cls).distinct()
    return d.join(table(spark, sf_dir, "submissions").select(*blank, cls).distinct(), key, "left_anti")


def newly_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions by status, and whether a draft knows them: a snapshot against what is there."""
    s = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row", "status"), ["work_answer_id"], ["submit_row"])
    m = rows.marked(s, table(spark, sf_dir, "drafts"), "work_answer_id")
    return m.groupBy("status", "known").agg(F.count(F.lit(1)).alias("n"), F.count_if(rows.pending(F.col("status"))).alias("waiting"))


def vision_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft scores overlaid by those of the last vision result of the submission."""
    v = rows.last_by(table(spark, sf_dir, "vision").select("work_answer_id", "vision_id", "score", "model_name"), ["work_answer_id"], ["vision_id"])
    d = table(spark, sf_dir, "drafts").select("draft_id", "work_answer_id", "draft_score")
    j = d.join(v, "work_answer_id", "left")
    return j.select("draft_id", F.coalesce(F.col("score").cast("double"), "draft_score").alias("score"), F.coalesce("model_name", F.lit("rules")).alias("source"))


def draft_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of approved rows over those of all others with the same submission, counted by origin."""
    d = table(spark, sf_dir, "drafts").where("work_answer_id is not null").select("work_answer_id", "draft_id", "approved")
    new = rows.last_by(d.where("approved"), ["work_answer_id"], ["draft_id"]).withColumn("origin", F.lit("new"))
    old = rows.last_by(d.where("not approved"), ["work_answer_id"], ["draft_id"]).withColumn("origin", F.lit("old"))
    return rows.upsert(old, new, ["work_answer_id"]).select("work_answer_id", "draft_id", "origin")


def foreign_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student numbers in a draft's comment that belong to another student."""
    d = table(spark, sf_dir, "drafts").select("draft_id", "student_no", F.explode(long_numbers(F.col("draft_comment"))).alias("number"))
    known = table(spark, sf_dir, "submissions").select(F.col("student_no").alias("number")).where("number <> ''").distinct()
    j = d.join(known, "number").where(F.col("number") != F.coalesce("student_no", F.lit("")))
    return j.select("draft_id", "number").distinct()


def evidence_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence tokens of the vision texts by the number of submissions that show them."""
    v = table(spark, sf_dir, "vision").select("work_answer_id", F.explode(evidence_tokens(F.col("extracted_text"))).alias("token"))
    return common_values(v, "work_answer_id", "token", 2, 0.0)


def evidence_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of submissions whose rarer evidence tokens are contained in each other's."""
    v = table(spark, sf_dir, "vision").select("work_answer_id", F.explode(evidence_tokens(F.col("extracted_text"))).alias("token"))
    return rare_containment_pairs(without_common(v, "work_answer_id", "token", 5, 0.01), "work_answer_id", "token", 0.6, 2)


def all_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_answer_id, token) from the last vision result and the last answer; a null token for none, so that all submissions count."""
    v = rows.last_by(table(spark, sf_dir, "vision").where("work_answer_id is not null"), ["work_answer_id"], ["vision_id"])
    s = rows.last_by(table(spark, sf_dir, "submissions").where("work_answer_id is not null").select("work_answer_id", "submit_row", "answer_text"), ["work_answer_id"], ["submit_row"])
    j = v.select("work_answer_id", "extracted_text", "summary", "review_comment").join(s.select("work_answer_id", "answer_text"), "work_answer_id", "full")
    text = F.concat_ws("\n", "extracted_text", "summary", "review_comment", "answer_text")
    return j.select("work_answer_id", F.explode_outer(reference_tokens(text)).alias("token"))


def evidence_frequency_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's evidence tokens of all four texts by the number of submissions that show them."""
    return common_values(all_evidence(spark, sf_dir), "work_answer_id", "token", 2, 0.0)


def evidence_containment_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of submissions by containment of all evidence tokens but those in a fifth of all submissions."""
    # Written once, as the tokens are read three times and the patterns are dear.
    path = scratch_path(spark, "evidence")
    all_evidence(spark, sf_dir).write.mode("append").parquet(path)
    rare = without_common(spark.read.parquet(path), "work_answer_id", "token", 5, 0.2)
    return rare_containment_pairs(rare, "work_answer_id", "token", 0.6, 2)


def answer_text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions of one assignment with similar answer texts."""
    s = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row", "assignment_id", "answer_text"), ["work_answer_id"], ["submit_row"])
    return text_pairs(s, "work_answer_id", "answer_text", ["assignment_id"], 0.6)


def embedding_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average hash of each vector read as 64 grey values."""
    return table(spark, sf_dir, "embeddings").select("vec_id", average_hash(F.col("embedding")).alias("hash"))


def nearest_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio test between vectors of different labels: every hundredth vector against all."""
    return ratio_matches(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.95)


QUERIES = {
    f.__name__: f
    for f in (
        canonical_pairs,
        pair_sides,
        partners,
        strongest_partner,
        earliest_partner,
        verdict_counts,
        verdict_cascade,
        evidence_groups,
        first_of_component,
        unmatched_students,
        newly_seen,
        vision_overlay,
        draft_upsert,
        foreign_numbers,
        evidence_frequency,
        evidence_containment,
        evidence_frequency_whole,
        evidence_containment_whole,
        answer_text_pairs,
        embedding_hashes,
        nearest_ratio,
    )
}

_PAIRS = """pairs as (select *, least(trim(a_work_answer_id), trim(b_work_answer_id)) low_id, greatest(trim(a_work_answer_id), trim(b_work_answer_id)) high_id,
  floor((coalesce(evidence_similarity, 0.0) * 100000 + coalesce(sift_inliers, 0) + coalesce(akaze_inliers, 0)) * 10000 + 0.5) / 10000 strength
  from advanced_pairs where trim(a_work_answer_id) <> trim(b_work_answer_id))"""
_SIDES = "sides as (select low_id me, high_id other, * from pairs union all select high_id me, low_id other, * from pairs)"
_LAST = "last as (select * from submissions qualify row_number() over (partition by work_answer_id order by submit_row desc) = 1)"
_TOKENS = r"""raw as (select work_answer_id w, coalesce(extracted_text, '') t from vision),
found as (
  select w, unnest(regexp_extract_all(' ' || t, '[^A-Za-z0-9_](\d{1,3}(?:\.\d{1,3}){3})\b', 1)) x from raw
  union all select w, unnest(regexp_extract_all(' ' || t, '[^A-Za-z0-9_](nc +-[a-z]+ +\d+)\b', 1)) from raw
  union all select w, unnest(regexp_extract_all(t, '(?i)(listening on +\S+(?: +\d+)?)', 1)) from raw
  union all select w, unnest(regexp_extract_all(t, '(?i)(connection received on +\S+)', 1)) from raw
  union all select w, unnest(regexp_extract_all(t, '(?i)(docker(?:[ -]compose)? +[a-z]+)', 1)) from raw
  union all select w, unnest(regexp_extract_all(t, '([A-Za-z0-9_-]+\.war)\b', 1)) from raw
  union all select w, unnest(regexp_extract_all(t, '((?:ldap|rmi)://[^\s|]+)', 1)) from raw
  union all select w, unnest(regexp_extract_all(t, '(https?://[^\s|<>"'']+)', 1)) from raw),
tokens as (select distinct w, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) token from found)"""

SQL = {
    "canonical_pairs": f"""with {_PAIRS} select low_id, high_id, count(*) as "rows", max(evidence_similarity) evidence,
  coalesce(bool_or(verdict = 'confirmed'), false) confirmed, count(distinct verdict) verdicts from pairs group by 1, 2""",
    "pair_sides": f"""with {_PAIRS}, {_LAST}, p as (select distinct low_id, high_id from pairs)
select low_id, high_id, a.submit_row row_a, b.submit_row row_b, coalesce(a.class_id = b.class_id, false) same_class,
  coalesce(a.assignment_id = b.assignment_id, false) same_assignment
from p left join last a on a.work_answer_id = low_id left join last b on b.work_answer_id = high_id""",
    "partners": f"""with {_PAIRS}, {_SIDES} select me work_answer_id, count(distinct other) partners, count(*) filter (verdict = 'confirmed') confirmed,
  count(*) filter (verdict = 'suspected') suspected from sides group by 1""",
    "strongest_partner": f"""with {_PAIRS}, {_SIDES} select me work_answer_id, other partner, strength from sides
qualify row_number() over (partition by me order by strength desc, other) = 1""",
    "earliest_partner": f"""with {_PAIRS}, {_SIDES}, {_LAST}
select me work_answer_id, other source, epoch_ms(o.collected_at) source_ms from sides
join last m on m.work_answer_id = me join last o on o.work_answer_id = other
where verdict = 'confirmed' and o.collected_at <= m.collected_at
qualify row_number() over (partition by me order by o.collected_at, strength desc, other) = 1""",
    "verdict_counts": "select verdict, verdict_source, count(*) n, count(distinct decision_reason) reasons from advanced_pairs group by 1, 2",
    "verdict_cascade": """
with x as (select verdict, coalesce(exact_object or exact_file, false) exact, coalesce(image_hash_similarity, 0) h, coalesce(evidence_similarity, 0) ev,
  coalesce(sift_inliers, 0) si, coalesce(sift_ratio, 0) sr, coalesce(sift_coverage, 0) sc,
  coalesce(akaze_inliers, 0) ai, coalesce(akaze_ratio, 0) ar, coalesce(akaze_coverage, 0) ac from advanced_pairs),
y as (select *, (si >= 300 and sr >= 0.18 and sc >= 0.45) or (ai >= 250 and ar >= 0.18 and ac >= 0.45) strong,
  (si >= 150 and sr >= 0.08) or (ai >= 120 and ar >= 0.08) moderate from x)
select case when exact then 'exact'
  when h >= 0.97 and si >= 500 and sr >= 0.35 and sc >= 0.45 and ai >= 250 and ar >= 0.18 and ac >= 0.40 then 'image'
  when si >= 1500 and sr >= 0.40 and sc >= 0.75 and ai >= 1500 and ar >= 0.60 and ac >= 0.50 and ev >= 0.65 then 'local'
  when si >= 500 and sr >= 0.24 and sc >= 0.45 and ai >= 400 and ar >= 0.24 and ac >= 0.42 and ev >= 0.50 then 'region'
  when si >= 500 and sr >= 0.35 and sc >= 0.45 and ev >= 0.35 then 'features'
  when strong and ev >= 0.95 then 'evidence'
  when strong or (moderate and ev >= 0.65) or ev >= 0.8 then 'suspected' else 'none' end ruled, verdict, count(*) n from y group by 1, 2""",
    "evidence_groups": """
with k as (select trim(a_work_answer_id) a, trim(b_work_answer_id) b, trim(unnest(string_split(exact_shared, ';'))) as "key" from advanced_pairs),
s as (select a me, "key" from k union all select b, "key" from k)
select "key", count(distinct me) members, (count(*) / 2)::bigint pairs from s
where "key" <> '' and not regexp_full_match(lower("key"), 'image_[0-9]+') group by 1 having count(distinct me) >= 2""",
    "first_of_component": f"""
with recursive {_PAIRS}, {_LAST}, e as (select low_id x, high_id y from pairs where verdict = 'confirmed' union select high_id, low_id from pairs where verdict = 'confirmed'),
reach(id, other) as (select x, y from e union select r.id, e.y from reach r join e on r.other = e.x),
c as (select id, least(id, min(other)) component from reach group by id)
select component, count(*) members, arg_min(id, (coalesce(submit_row, 4611686018427387904), id)) "first"
from c left join last on work_answer_id = id group by 1""",
    "unmatched_students": """
select distinct coalesce(student_no, '') student_no, coalesce(student_name, '') student_name, coalesce(lower(trim(class_name)), '') class_key from drafts
except select coalesce(student_no, ''), coalesce(student_name, ''), coalesce(lower(trim(class_name)), '') from submissions""",
    "newly_seen": f"""with {_LAST}, m as (select status, coalesce(work_answer_id in (select work_answer_id from drafts where work_answer_id is not null), false) known from last)
select status, known, count(*) n, count(*) filter (regexp_matches(status, '待批阅|重做待批阅|批阅') and not regexp_matches(status, '已完成|已批|查看')) waiting
from m group by 1, 2""",
    "vision_overlay": """
with v as (select * from vision qualify row_number() over (partition by work_answer_id order by vision_id desc) = 1)
select draft_id, coalesce(v.score::double, draft_score) score, coalesce(model_name, 'rules') source from drafts left join v using (work_answer_id)""",
    "draft_upsert": """
with d as (select work_answer_id, approved, max(draft_id) draft_id from drafts where work_answer_id is not null and approved is not null group by 1, 2)
select work_answer_id, draft_id, 'new' origin from d where approved
union all select work_answer_id, draft_id, 'old' from d where not approved and work_answer_id not in (select work_answer_id from d where approved)""",
    "foreign_numbers": r"""
with n as (select draft_id, student_no, unnest(regexp_extract_all(regexp_replace(coalesce(draft_comment, ''), '[^0-9]+', '  ', 'g'), '(?:^| )([0-9]{10})(?: |$)', 1)) number from drafts)
select distinct draft_id, number from n where number in (select student_no from submissions) and number <> coalesce(student_no, '')""",
    "evidence_frequency": f"""with {_TOKENS} select token, count(*) records from tokens group by 1 having count(*) >= 2""",
    "evidence_containment": f"""
with {_TOKENS}, n as (select count(distinct w) n from tokens),
common as (select token from tokens, n group by token, n.n having count(*) >= 5 and count(*) >= 0.01 * n.n),
r as (select * from tokens where token not in (select token from common)), z as (select w, count(*) n from r group by 1 having count(*) >= 2)
select a.w a, b.w b, count(*) shared, floor(count(*) / least(za.n, zb.n) * 10000 + 0.5) / 10000 containment
from r a join r b using (token) join z za on za.w = a.w join z zb on zb.w = b.w where a.w < b.w
group by a.w, b.w, za.n, zb.n having floor(count(*) / least(za.n, zb.n) * 10000 + 0.5) / 10000 >= 0.6""",
    "answer_text_pairs": rf"""
with {_LAST}, t as (select work_answer_id w, assignment_id g, lower(regexp_replace(coalesce(answer_text, ''), '[\s\x{{00a0}}\x{{3000}}\x{{feff}}]|[，。；：,.!?！？、]', '', 'g')) t from last),
s as (select w, g, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) x from t where length(t) >= 20),
p as (select a.w a, b.w b, len(list_intersect(a.x, b.x)) i, len(a.x) na, len(b.x) nb from s a join s b on a.g = b.g and a.w < b.w)
select a, b, floor(i / (na + nb - i) * 10000 + 0.5) / 10000 text_similarity from p where floor(i / (na + nb - i) * 10000 + 0.5) / 10000 >= 0.6""",
    "embedding_hashes": """
with e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings where len(embedding) >= 64)
select vec_id, list_aggregate(list_transform(v[1:64], lambda x: case when x * 64 >= list_sum(v[1:64]) then '1' else '0' end), 'string_agg', '') hash from e""",
    "nearest_ratio": """
with p as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings),
d as (select q.vec_id f, p.vec_id t, sqrt(list_sum(list_transform(list_zip(q.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) d
  from p q join p on q.label <> p.label where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by f order by d, t) k from d)
select a.f from_id, a.t to_id, floor(a.d * 10000 + 0.5) / 10000 distance, floor(a.d / b.d * 10000 + 0.5) / 10000 ratio
from r a join r b on a.f = b.f and a.k = 1 and b.k = 2 where a.d / b.d < 0.95""",
}

_QUOTED = [p.replace("'", "''") for p in REFERENCE_EVIDENCE]
_WS = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _evidence(texts: str, n: str = "") -> str:
    """The tables v, s, t and k (with ``n`` behind their names) of the evidence tokens in the given texts."""
    found = " union all ".join(f"select w, unnest(regexp_extract_all(t, '{p}')) token from t{n}" for p in _QUOTED)
    return rf"""v{n} as (select * from vision where work_answer_id is not null qualify row_number() over (partition by work_answer_id order by vision_id desc) = 1),
    s{n} as (select * from submissions where work_answer_id is not null qualify row_number() over (partition by work_answer_id order by submit_row desc) = 1),
    t{n} as (select coalesce(v{n}.work_answer_id, s{n}.work_answer_id) w,
      lower(regexp_replace(concat_ws(chr(10), {texts}), '{_WS}+', ' ', 'g')) t from v{n} full join s{n} on v{n}.work_answer_id = s{n}.work_answer_id),
    k{n} as (select distinct w, token from ({found}))"""


_ALL_EVIDENCE = _evidence("extracted_text, summary, review_comment, answer_text")

SQL |= {
    "evidence_frequency_whole": f"with {_ALL_EVIDENCE} select token, count(*) records from k group by 1 having count(*) >= 2",
    "evidence_containment_whole": f"""
with {_ALL_EVIDENCE}, n as (select count(*) n from t),
common as (select token from k, n group by token, n.n having count(*) >= 5 and count(*) >= 0.2 * n.n),
r as (select *, count(*) over (partition by w) size from k where token not in (select token from common)),
m as (select a.w a, b.w b, count(*) shared, least(a.size, b.size) least_size from r a join r b using (token) where a.w < b.w and a.size >= 2 and b.size >= 2 group by 1, 2, 4)
select a, b, shared, floor(shared / least_size * 10000 + 0.5) / 10000 containment from m where floor(shared / least_size * 10000 + 0.5) / 10000 >= 0.6""",
}
