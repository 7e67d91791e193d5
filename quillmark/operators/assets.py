"""Asset operators: real ids, which assets count, ordered dedup, representative choice, merge by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.common import common_values

#: Files below this many bytes are thumbnails or icons.
LEAST_BYTES = 5000


def real_object_id(object_id: Column, src: Column) -> Column:
    """The object id unless it is blank or a placeholder image_N; else the hexadecimal id in the URL; else null."""
    bare = F.lower(F.trim(object_id))
    from_url = F.lower(F.regexp_extract(src, r"/([0-9a-fA-F]{24,64})(?:\.|$)", 1))
    return F.coalesce(F.when((bare != "") & ~bare.rlike(r"^image_\d+$"), bare), F.nullif(from_url, F.lit("")))


def student_image(src: Column) -> Column:
    """Whether a URL points into the store of submitted images."""
    return F.coalesce(F.parse_url(src, F.lit("HOST")).rlike(r"^p\d+\.") & F.parse_url(src, F.lit("PATH")).contains("/star/"), F.lit(False))


def origin_url(src: Column) -> Column:
    """The address of the full picture: of a thumbnail /star3/750_1024/ID.* the origin with the same id as JPEG, of
    an origin itself; '' for others."""
    ident = F.regexp_extract(src, r"/([0-9a-fA-F]{24,64})(?:\.|$)", 1)
    base = F.regexp_extract(src, r"^(https?://[^/]+)/", 1)
    small = src.rlike(r"^https?://[^/]+/star3/750_1024/") & (ident != "")
    full = src.rlike(r"^https?://[^/]+/(?:star3/origin/|star4/[^/]+/origin)") & (ident != "")
    return F.coalesce(F.when(full, src).when(small, F.concat(base, F.lit("/star3/origin/"), ident, F.lit(".jpg"))), F.lit(""))


# Parts of a file name that tell decoration.
DECORATION = "avatar|head|icon|logo|button|btn|emoji|face|loading|blank|default"


def answer_image(ok: Column, n_bytes: Column, name: Column) -> Column:
    """Whether a downloaded file is likely part of an answer: not small, not named as decoration."""
    decoration = F.coalesce(F.lower(name).rlike(f"(?:^|[/_-])({DECORATION})(?:[/_.-]|$)"), F.lit(False))
    small = F.coalesce((n_bytes > 0) & (n_bytes < LEAST_BYTES), F.lit(False))
    return F.coalesce(ok, F.lit(False)) & ~small & ~decoration


def first_of_each(assets: DataFrame) -> DataFrame:
    """The first asset of each submission and source, in the order of question and image."""
    order = F.struct(F.coalesce("question_index", F.lit(0)), F.coalesce("image_index", F.lit(0)), F.coalesce("file_name", F.lit("")), F.coalesce("sha256", F.lit("")), F.coalesce("object_id", F.lit("")))
    rest = [c for c in assets.columns if c not in ("work_answer_id", "src")]
    best = assets.groupBy("work_answer_id", "src").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select("work_answer_id", "src", "r.*")


def representatives(assets: DataFrame, most: int = 6) -> DataFrame:
    """Up to ``most`` assets of each submission: the first three, the last two, then the largest; in order."""
    w = Window.partitionBy("work_answer_id")
    order = [F.col(c).asc_nulls_first() for c in ("question_index", "image_index", "src")]
    back = [F.col(c).desc_nulls_last() for c in ("question_index", "image_index", "src")]
    placed = assets.withColumns({"at": F.row_number().over(w.orderBy(*order)), "from_end": F.row_number().over(w.orderBy(*back))})
    first = F.when(F.col("at") <= 3, 0).when(F.col("from_end") <= 2, 1).otherwise(2)
    # largest first among the rest; the first three and last two by their place
    size = F.when(first == 2, -F.coalesce("n_bytes", F.lit(0))).otherwise(F.col("at").cast("long"))
    chosen = placed.withColumn("pick", F.row_number().over(w.orderBy(first, size, "at"))).where(F.col("pick") <= most)
    return chosen.drop("from_end", "pick")


def clean_counts(assets: DataFrame) -> DataFrame:
    """By submission: assets, kept, removed as not an answer's, removed as common."""
    real = assets.withColumn("oid", real_object_id(F.col("object_id"), F.col("src")))
    common = common_values(real.where("ok"), "work_answer_id", "oid").select("oid", F.lit(True).alias("common"))
    marked = real.join(common, "oid", "left")
    good = answer_image(F.col("ok"), F.col("n_bytes"), F.col("file_name")) & student_image(F.col("src"))
    shared = F.coalesce("common", F.lit(False))
    return marked.groupBy("work_answer_id").agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if(good & ~shared).alias("kept"),
        F.count_if(~good).alias("removed"),
        F.count_if(good & shared).alias("removed_common"),
    )


def merged_by_source(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Assets of ``old`` replaced by those of ``fresh`` with the same submission and source; new sources come
    along only if they were downloaded."""
    key = ["work_answer_id", "src"]
    o, f = first_of_each(old), first_of_each(fresh.where("ok"))
    joined = o.alias("o").join(f.alias("f"), key, "full")
    cols = [F.coalesce(F.col(f"f.{c}"), F.col(f"o.{c}")).alias(c) for c in ("ok", "n_bytes", "sha256")]
    origin = F.when(F.col("o.ok").isNull(), "new").when(F.col("f.ok").isNull(), "old").otherwise("replaced")
    return joined.select(*key, *cols, origin.alias("origin"))
