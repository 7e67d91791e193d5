"""Registered queries over free text: clean-up, extraction, escaping, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import extract, scalars
from quillmark.functions.scalars import half_up
from quillmark.sources.tables import table


def digest(c):
    return F.md5(c.cast("binary"))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text in the clean-up forms, as digests and lengths."""
    t = F.col("text")
    bare, ocr = scalars.bare_text(t), scalars.ocr_text(t)
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(bare).alias("bare"), F.length(bare).cast("long").alias("bare_chars"), digest(ocr).alias("ocr"), digest(scalars.slug(t, 80)).alias("slug"), F.left(scalars.squeeze(t), F.lit(40)).alias("head")
    )


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read as HTML and escaped as HTML, as digests."""
    t = F.col("text")
    plain = scalars.html_text(t)
    return table(spark, sf_dir, "documents").select("doc_id", digest(plain).alias("plain"), F.length(plain).cast("long").alias("plain_chars"), digest(scalars.html_escape(t)).alias("escaped"))


def marked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between the earliest start marker and the earliest end marker of a lab report."""
    part = scalars.between(F.col("text"), ["二、环境准备", "## Setup", "Setup"], ["三、操作过程", "## Procedure", "Procedure", "## Findings"])
    return table(spark, sf_dir, "documents").select("doc_id", digest(part).alias("part"), F.length(part).cast("long").alias("chars")).where("part is not null")


def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts named in each document's first twenty different URLs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.urls_in(F.col("text"))).alias("url"))
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return d.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("urls"), F.countDistinct("doc_id").alias("documents"))


def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character 3-grams of the answer texts in at least three submissions' texts."""
    s = table(spark, sf_dir, "submissions").select("submit_row", F.explode(scalars.ngrams(scalars.bare_text(F.col("answer_text")))).alias("gram"))
    return s.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where("rows >= 3")


def guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft texts as cells that no spreadsheet takes for a formula."""
    d = table(spark, sf_dir, "drafts")
    return d.select("draft_id", digest(scalars.csv_guard(F.col("draft_comment"))).alias("draft_comment"), scalars.csv_guard(F.col("risk")).alias("risk"), scalars.csv_guard((F.col("draft_score") - 50).cast("long").cast("string")).alias("gap"))


def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as a model would reply them: plain, fenced, amid words, broken; the value read back."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    kind = F.col("event_id") % 4
    said = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I think "), "props", F.lit(" is it."))).otherwise(F.concat(F.lit("none {"), F.col("event_id").cast("string")))
    value = F.get_json_object(scalars.json_object(said), "$.k").try_cast("double")
    return e.select("event_id", scalars.clamp(value, 50).alias("clamped"), value.isNull().alias("missing"))


def decoded_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of one ASCII line sent as base64 amid a text, found and decoded again."""
    return sent_and_decoded(table(spark, sf_dir, "drafts").where("basis rlike '^[ -~]{18,}$'"))


def decoded_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all drafts, whatever their comments' script, length and lines."""
    return sent_and_decoded(table(spark, sf_dir, "drafts"))


def sent_and_decoded(d: DataFrame) -> DataFrame:
    sent = F.concat(F.lit("payload "), F.regexp_replace(F.base64(F.col("basis").cast("binary")), r"\s+", ""), F.lit(" end"))
    return d.select("draft_id", F.array_join(extract.base64_pieces(sent), "; ").alias("decoded"))


def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the vision results miss: how often, and the mean score where they are missed."""
    v = table(spark, sf_dir, "vision").select("score", F.explode(F.array_distinct("missing_items")).alias("item"))
    return v.groupBy("item").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("score"), 4).alias("mean_score"))


def vision_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vision scores with defaults for missing parts: two fifths, two fifths and a fifth of the score."""
    v = table(spark, sf_dir, "vision")
    part = lambda c, share, most: scalars.clamp(F.coalesce(F.col(c).cast("double"), F.col("score") * share), most)
    return v.select("vision_id", part("content_score", 0.4, 40).alias("content"), part("evidence_score", 0.4, 40).alias("evidence"), part("layout_score", 0.2, 20).alias("layout"), F.array_join(F.slice("missing_items", 1, 12), "; ").alias("missing"))


def price_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-up rounding at two and zero places, and clamping, over line items."""
    x = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.floor(x * 100 + 0.5).cast("long")).alias("cents"), F.sum(F.floor(x + 0.5).cast("long")).alias("units"), F.sum(scalars.clamp(x / 1000, 60).cast("long")).alias("clamped"))


QUERIES = {f.__name__: f for f in (text_scalars, html_texts, marked_parts, url_lists, gram_counts, guarded_cells, tolerant_json, decoded_pieces, decoded_whole, missing_items, vision_parts, price_rounding)}

_WS = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_BARE = rf"lower(regexp_replace(coalesce(text, ''), '{_WS}|[，。；：,.!?！？、]', '', 'g'))"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'), ' ')"


_OCR = r"translate(coalesce(text, ''), '\｜“”‘’`：', '//" + '""' + "'''''':')"
_GUARD = "case when regexp_matches(coalesce({0}, ''), '^[=+\\-@]') then '''' || {0} else coalesce({0}, '') end"

SQL = {
    "text_scalars": rf"""
select doc_id, md5({_BARE}) bare, length({_BARE}) bare_chars,
  md5(lower({_squeeze(_OCR)})) ocr,
  md5(coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(trim(text, ' '), '[\\/:*?"<>|]+', '_', 'g'), '{_WS}+', '_', 'g'), '_+', '_', 'g'), 1, 80), ''), 'item')) slug,
  substr({_squeeze("text")}, 1, 40) head from documents""",
    "html_texts": r"""
with a as (select doc_id, text, regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') s from documents),
b as (select doc_id, text, regexp_replace(regexp_replace(s, '(?i)</(h[1-6]|p|div|li|tr|pre|code)>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') s from a),
c as (select doc_id, text, replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', '''') s from b),
d as (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(s, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$', '', 'g') s from c)
select doc_id, md5(s) plain, length(s) plain_chars,
  md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) escaped from d""",
    "marked_parts": """
with m as (select doc_id, text, list_min(list_filter([
    case when instr(text, '二、环境准备') > 0 then struct_pack("at" := instr(text, '二、环境准备'), n := 6) end,
    case when instr(text, '## Setup') > 0 then struct_pack("at" := instr(text, '## Setup'), n := 8) end,
    case when instr(text, 'Setup') > 0 then struct_pack("at" := instr(text, 'Setup'), n := 5) end], lambda x: x is not null)) f from documents),
r as (select doc_id, substr(text, f."at" + f.n) rest from m where f is not null),
e as (select doc_id, rest, list_min(list_filter([instr(rest, '三、操作过程'), instr(rest, '## Procedure'), instr(rest, 'Procedure'), instr(rest, '## Findings')], lambda x: x > 0)) z from r),
p as (select doc_id, trim(case when z is null then rest else substr(rest, 1, z - 1) end, ' ') part from e)
select doc_id, md5(part) part, length(part) chars from p""",
    "url_lists": r"""
with u as (select doc_id, regexp_extract_all(text, '(https?://[^\s<>"''）)\]，。、|]+)', 1) l from documents),
o as (select doc_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:20]) url from u)
select regexp_extract(url, '^https?://([^/?#]+)', 1) host, count(*) urls, count(distinct doc_id) documents from o group by 1""",
    "gram_counts": rf"""
with t as (select submit_row, lower(regexp_replace(coalesce(answer_text, ''), '{_WS}|[，。；：,.!?！？、]', '', 'g')) t from submissions),
g as (select distinct submit_row, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) gram from t)
select gram, count(*) as "rows" from g group by 1 having count(*) >= 3""",
    "guarded_cells": f"""
select draft_id, md5({_GUARD.format("draft_comment")}) draft_comment, {_GUARD.format("risk")} risk, {_GUARD.format("trunc(draft_score - 50)::bigint::varchar")} gap from drafts""",
    "tolerant_json": """
with v as (select event_id, case when event_id % 4 < 3 then json_extract_string(props, '$.k')::double end k from events)
select event_id, least(50.0, greatest(0.0, floor(coalesce(k, 0.0) + 0.5)))::double clamped, k is null missing from v""",
    "decoded_pieces": """
select draft_id, case when length(rtrim(to_base64(encode(basis)), '=')) >= 24 then basis else '' end decoded
from drafts where regexp_full_match(basis, '[ -~]{18,}')""",
    "missing_items": """
with i as (select score, unnest(list_distinct(missing_items)) item from vision)
select item, count(*) n, floor(avg(score) * 10000 + 0.5) / 10000 mean_score from i group by 1""",
    "vision_parts": """
select vision_id, least(40.0, greatest(0.0, floor(coalesce(content_score, score * 0.4::double, 0) + 0.5)))::double content,
  least(40.0, greatest(0.0, floor(coalesce(evidence_score, score * 0.4::double, 0) + 0.5)))::double evidence,
  least(20.0, greatest(0.0, floor(coalesce(layout_score, score * 0.2::double, 0) + 0.5)))::double layout,
  case when missing_items is not null then array_to_string(missing_items[1:12], '; ') end missing from vision""",
    "price_rounding": """
with x as (select *, l_extendedprice * (1 - l_discount) x from lineitem)
select l_returnflag, l_linestatus, sum(floor(x * 100 + 0.5)::bigint)::bigint cents, sum(floor(x + 0.5)::bigint)::bigint units,
  sum(least(60.0, greatest(0.0, floor(x / 1000 + 0.5)))::bigint)::bigint clamped from x group by 1, 2""",
}

_SHOWN = r"regexp_replace(basis, '[^\x20-\x7e\t\n\x{000b}\f\r]', '', 'g')"
SQL["decoded_whole"] = f"""
select draft_id, case when length(rtrim(to_base64(encode(basis)), '=')) >= 24 and length(basis) >= 8
  and length({_SHOWN}) > 0.75 * length(basis) then basis else '' end decoded from drafts"""
