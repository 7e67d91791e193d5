"""Registered queries over assets and the pairs of submissions that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.scalars import bits, mime_of
from quillmark.operators import assets as ops
from quillmark.operators.common import common_values, shared_value_pairs, without_common
from quillmark.operators.similarity import best_match_mean, code_pairs
from quillmark.sources.tables import table


def real_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each kind of stored object id was resolved."""
    a = table(spark, sf_dir, "assets")
    oid = ops.real_object_id(F.col("object_id"), F.col("src"))
    kind = F.when(F.col("object_id").isNull(), "missing").when(F.trim("object_id") == "", "blank").when(F.lower(F.trim("object_id")).rlike(r"^image_\d+$"), "placeholder").otherwise("real")
    return a.groupBy(kind.alias("stored")).agg(F.count(F.lit(1)).alias("n"), F.count(oid).alias("resolved"), F.countDistinct(oid).alias("ids"))


def common_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in at least five submissions and two percent of them."""
    a = table(spark, sf_dir, "assets").where("ok").withColumn("oid", ops.real_object_id(F.col("object_id"), F.col("src")))
    return common_values(a, "work_answer_id", "oid", 5, 0.02)


def exact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of submissions that share files, left out those in 0.2 percent of submissions; exact_links and exact_members are whole."""
    a = table(spark, sf_dir, "assets").where("ok").withColumn("sha", F.nullif(F.lower(F.trim("sha256")), F.lit("")))
    rare = without_common(a.select("work_answer_id", "sha"), "work_answer_id", "sha", 5, 0.002)
    return shared_value_pairs(rare, "work_answer_id", "sha")


def specific_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloaded assets with real id and hash, left out those whose id or hash is in a fifth of all submissions."""
    a = table(spark, sf_dir, "assets").where("ok")
    a = a.select("work_answer_id", ops.real_object_id(F.col("object_id"), F.col("src")).alias("object"), F.nullif(F.lower(F.trim("sha256")), F.lit("")).alias("file"), "ahash")
    everyone = table(spark, sf_dir, "submissions").select("work_answer_id", F.lit(None).cast("string").alias("none"))
    # Found over all assets before any is left out; both lists are short whatever the size of the data.
    common = {key: common_values(a.select("work_answer_id", key).union(everyone), "work_answer_id", key, 5, 0.2) for key in ("object", "file")}
    for key, values in common.items():
        a = a.join(F.broadcast(values.select(key)), key, "left_anti")
    return a


def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_answer_id, kind, value, records) for the real ids and hashes of specific assets."""
    a = specific_assets(spark, sf_dir)
    key = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("object", "file")]))
    seen = a.select("work_answer_id", key.alias("k")).select("work_answer_id", "k.kind", "k.value").where("work_answer_id is not null and value is not null").distinct()
    return seen.join(seen.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("records")), ["kind", "value"])


def exact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per submission its specific ids and files, and how often others have them: the pairs by number, in linear size."""
    k = shared_keys(spark, sf_dir)
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    return k.groupBy("work_answer_id").agg(*[of(c, x).alias(f"{c}{name}") for c in ("object", "file") for name, x in (("s", F.lit(1)), ("_links", F.col("records") - 1))])


def exact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions by the specific id or file that they share: every pair of the overlap, without writing the pairs."""
    return shared_keys(spark, sf_dir).where("records >= 2").select("kind", "value", "work_answer_id", "records")


def asset_clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean_counts(table(spark, sf_dir, "assets"))


def asset_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six representative assets of each submission."""
    one = ops.first_of_each(table(spark, sf_dir, "assets").where("ok"))
    return ops.representatives(one).select("work_answer_id", "src", "at", "n_bytes")


def asset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed downloads merged with those of later questions, by origin."""
    a = table(spark, sf_dir, "assets")
    merged = ops.merged_by_source(a.where("question_index = 1"), a.where("question_index > 1"))
    return merged.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"), F.sum("n_bytes").alias("n_bytes"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, folders and types of the assets' URLs."""
    a = table(spark, sf_dir, "assets")
    url = F.col("src")
    keys = [F.parse_url(url, F.lit("HOST")).alias("host"), F.regexp_extract(F.parse_url(url, F.lit("PATH")), "^(/[^/]*/)", 1).alias("folder"), mime_of(url).alias("mime")]
    per = a.groupBy(*keys, ops.student_image(url).alias("student_image"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if(mime_of(url) == F.col("content_type")).alias("same_type"))


def near_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different average hashes at most five bits apart."""
    a = table(spark, sf_dir, "assets").where("ok").select(bits(F.col("ahash")).alias("code"))
    return code_pairs(a, "code", 5)


def image_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean best and best likeness of the images of each matched pair, without those of common hashes."""
    a = table(spark, sf_dir, "assets").where("ok").select("work_answer_id", bits(F.col("ahash")).alias("code")).where("code is not null")
    rare = without_common(a, "work_answer_id", "code", 5, 0.005)
    p = table(spark, sf_dir, "advanced_pairs").select(F.trim("a_work_answer_id").alias("x"), F.trim("b_work_answer_id").alias("y")).where("x < y")
    return best_match_mean(p, rare, "x", "y", "work_answer_id", "code")


def image_likeness_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and best likeness of the images of given pairs, over all images but those of common assets."""
    a = specific_assets(spark, sf_dir).select("work_answer_id", bits(F.col("ahash")).alias("code"))
    p = table(spark, sf_dir, "advanced_pairs").select(F.trim("a_work_answer_id").alias("x"), F.trim("b_work_answer_id").alias("y")).where("x < y")
    return best_match_mean(p, a, "x", "y", "work_answer_id", "code")


def asset_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per submission: assets, downloaded, bytes, kinds of failure; the valid count falls back to all rows."""
    a = table(spark, sf_dir, "assets")
    return a.groupBy("work_answer_id").agg(
        F.count(F.lit(1)).alias("assets"),
        F.coalesce(F.nullif(F.count_if("ok"), F.lit(0)), F.count(F.lit(1))).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_bytes"))), F.lit(0)).alias("n_bytes"),
        F.countDistinct("error_text").alias("failures"),
    )


QUERIES = {f.__name__: f for f in (real_ids, common_assets, exact_overlap, exact_links, exact_members, asset_clean_counts, asset_choice, asset_merge, url_parts, near_codes, image_likeness, image_likeness_whole, asset_load)}

_OID = r"""coalesce(case when trim(object_id) <> '' and not regexp_full_match(lower(trim(object_id)), 'image_[0-9]+') then lower(trim(object_id)) end,
  nullif(lower(regexp_extract(src, '/([0-9a-fA-F]{24,64})(?:\.|$)', 1)), ''))"""
_FIRST = """row_number() over (partition by work_answer_id, src order by coalesce(question_index, 0), coalesce(image_index, 0), coalesce(file_name, ''), coalesce(sha256, ''), coalesce(object_id, '')) = 1"""
_STUDENT = r"coalesce(regexp_matches(src, '^https?://p[0-9]+\.[^/]*/') and contains(regexp_extract(src, '^https?://[^/]*(/[^?#]*)', 1), '/star/'), false)"
_MIME = r"""case when lower(regexp_extract(src, '\.([A-Za-z0-9]+)$', 1)) in ('jpg', 'jpeg') then 'image/jpeg'
  when lower(regexp_extract(src, '\.([A-Za-z0-9]+)$', 1)) in ('png', 'webp', 'gif', 'bmp') then 'image/' || lower(regexp_extract(src, '\.([A-Za-z0-9]+)$', 1)) end"""
_BITS = """(list_sum(list_transform(range(0, 64), lambda i: case when ahash[i + 1] = '1' then (1::hugeint << (63 - i)::hugeint) else 0::hugeint end))::hugeint)"""

SQL = {
    "real_ids": f"""
select case when object_id is null then 'missing' when trim(object_id) = '' then 'blank'
  when regexp_full_match(lower(trim(object_id)), 'image_[0-9]+') then 'placeholder' else 'real' end stored,
  count(*) n, count({_OID}) resolved, count(distinct {_OID}) ids from assets group by 1""",
    "common_assets": f"""
with s as (select distinct work_answer_id, {_OID} oid from assets where ok),
n as (select count(distinct work_answer_id) n from s)
select oid, count(*) records from s, n where oid is not null group by oid, n.n having count(*) >= 5 and count(*) >= 0.02 * n.n""",
    "exact_overlap": """
with s as (select distinct work_answer_id w, nullif(lower(trim(sha256)), '') sha from assets where ok),
n as (select count(distinct w) n from s),
common as (select sha from s, n where sha is not null group by sha, n.n having count(*) >= 5 and count(*) >= 0.002 * n.n),
r as (select * from s where sha is not null and sha not in (select sha from common))
select a.w a, b.w b, count(*) shared from r a join r b using (sha) where a.w < b.w group by 1, 2""",
    "asset_clean_counts": f"""
with x as (select *, {_OID} oid from assets),
n as (select count(distinct work_answer_id) n from x where ok),
common as (select oid from (select distinct work_answer_id, oid from x where ok and oid is not null), n group by oid, n.n having count(*) >= 5 and count(*) >= 0.2 * n.n),
m as (select *, coalesce(ok, false) and not coalesce(n_bytes > 0 and n_bytes < 5000, false)
   and not coalesce(regexp_matches(lower(file_name), '(^|[/_-])(avatar|head|icon|logo|button|btn|emoji|face|loading|blank|default)([/_.-]|$)'), false) and {_STUDENT} good,
   coalesce(oid in (select oid from common), false) shared from x)
select work_answer_id, count(*) assets, count(*) filter (good and not shared) kept, count(*) filter (not good) removed,
  count(*) filter (good and shared) removed_common from m group by 1""",
    "asset_choice": f"""
with one as (select * from assets where ok qualify {_FIRST}),
p as (select *, row_number() over (partition by work_answer_id order by question_index nulls first, image_index nulls first, src) as "at",
  row_number() over (partition by work_answer_id order by question_index desc nulls last, image_index desc nulls last, src desc) z from one),
c as (select *, case when "at" <= 3 then 0 when z <= 2 then 1 else 2 end f from p)
select work_answer_id, src, "at"::int as "at", n_bytes from c
qualify row_number() over (partition by work_answer_id order by f, case when f = 2 then -coalesce(n_bytes, 0) else "at" end, "at") <= 6""",
    "asset_merge": f"""
with o as (select * from assets where question_index = 1 qualify {_FIRST}), f as (select * from assets where question_index > 1 and ok qualify {_FIRST}),
m as (select case when o.ok is null then 'new' when f.ok is null then 'old' else 'replaced' end origin, coalesce(f.ok, o.ok) ok, coalesce(f.n_bytes, o.n_bytes) n_bytes
  from o full join f on o.work_answer_id = f.work_answer_id and o.src = f.src)
select origin, count(*) n, count(*) filter (ok) ok, sum(n_bytes)::bigint n_bytes from m group by 1""",
    "url_parts": f"""
select regexp_extract(src, '^https?://([^/]*)', 1) as host, regexp_extract(src, '^https?://[^/]*(/[^/]*/)', 1) folder, {_MIME} mime, {_STUDENT} student_image,
  count(*) n, count(*) filter ({_MIME} = content_type) same_type from assets group by 1, 2, 3, 4""",
    "near_codes": f"""
with raw as (select distinct ahash from assets where ok and regexp_full_match(ahash, '[01]{{64}}')),
x as (select ahash, {_BITS} u from raw), c as (select case when u >= 9223372036854775808 then (u - 18446744073709551616)::bigint else u::bigint end c from x)
select p.c a, q.c b, bit_count(xor(p.c, q.c))::int distance from c p join c q on p.c < q.c and bit_count(xor(p.c, q.c)) <= 5""",
    "image_likeness": f"""
with raw as (select distinct work_answer_id w, ahash from assets where ok and regexp_full_match(ahash, '[01]{{64}}')),
n as (select count(distinct w) n from raw),
common as (select ahash from raw, n group by ahash, n.n having count(*) >= 5 and count(*) >= 0.005 * n.n),
x as (select w, {_BITS} u from raw where ahash not in (select ahash from common)),
h as (select w, list(case when u >= 9223372036854775808 then (u - 18446744073709551616)::bigint else u::bigint end) cs from x group by w),
p as (select distinct trim(a_work_answer_id) a, trim(b_work_answer_id) b from advanced_pairs where trim(a_work_answer_id) < trim(b_work_answer_id)),
j as (select a, b, case when len(ha.cs) <= len(hb.cs) then ha.cs else hb.cs end s, case when len(ha.cs) <= len(hb.cs) then hb.cs else ha.cs end l
  from p join h ha on ha.w = a join h hb on hb.w = b),
k as (select a, b, list_transform(s, lambda x: list_max(list_transform(l, lambda y: 1 - bit_count(xor(x, y)) / 64))) m from j)
select a, b, floor(list_sum(m) / len(m) * 10000 + 0.5) / 10000 mean_best, floor(list_max(m) * 10000 + 0.5) / 10000 best from k""",
    "asset_load": """
select work_answer_id, count(*) assets, coalesce(nullif(count(*) filter (ok), 0), count(*)) valid,
  coalesce(sum(n_bytes) filter (ok), 0)::bigint n_bytes, count(distinct error_text) failures from assets group by 1""",
}

_SPECIFIC = f"""x as (select work_answer_id w, {_OID} "object", nullif(lower(trim(sha256)), '') file, ahash from assets where ok),
n as (select count(distinct w) n from (select w from x union all select work_answer_id from submissions)),
co as (select "object" v from x, n where "object" is not null group by "object", n.n having count(distinct w) >= 5 and count(distinct w) >= 0.2 * n.n),
cf as (select file v from x, n where file is not null group by file, n.n having count(distinct w) >= 5 and count(distinct w) >= 0.2 * n.n),
kept as (select * from x where not coalesce("object" in (select v from co), false) and not coalesce(file in (select v from cf), false))"""
_SHARED = f"""{_SPECIFIC},
k as (select distinct w, 'object' kind, "object" "value" from kept where "object" is not null union select distinct w, 'file', file from kept where file is not null),
s as (select *, count(*) over (partition by kind, "value") records from k where w is not null)"""

SQL |= {
    "exact_links": f"""with {_SHARED} select w work_answer_id, count(*) filter (kind = 'object') objects, coalesce(sum(records - 1) filter (kind = 'object'), 0)::bigint object_links,
  count(*) filter (kind = 'file') files, coalesce(sum(records - 1) filter (kind = 'file'), 0)::bigint file_links from s group by 1""",
    "exact_members": f"""with {_SHARED} select kind, "value", w work_answer_id, records from s where records >= 2""",
    "image_likeness_whole": f"""
with {_SPECIFIC}, u as (select distinct w, {_BITS} u from kept where regexp_full_match(ahash, '[01]{{64}}')),
h as (select w, list(case when u >= 9223372036854775808 then (u - 18446744073709551616)::bigint else u::bigint end) cs from u group by w),
p as (select distinct trim(a_work_answer_id) a, trim(b_work_answer_id) b from advanced_pairs where trim(a_work_answer_id) < trim(b_work_answer_id)),
j as (select a, b, case when len(ha.cs) <= len(hb.cs) then ha.cs else hb.cs end s, case when len(ha.cs) <= len(hb.cs) then hb.cs else ha.cs end l
  from p join h ha on ha.w = a join h hb on hb.w = b),
m as (select a, b, list_transform(s, lambda x: list_max(list_transform(l, lambda y: 1 - bit_count(xor(x, y)) / 64))) m from j)
select a, b, floor(list_sum(m) / len(m) * 10000 + 0.5) / 10000 mean_best, floor(list_max(m) * 10000 + 0.5) / 10000 best from m""",
}
