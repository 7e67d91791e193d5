"""Registered queries for reviewing matched pairs: candidates, overall likeness, filters, merges, groups and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import extract, scalars
from quillmark.functions.scalars import bits, half_up
from quillmark.operators import assets as asset_ops
from quillmark.operators import rows
from quillmark.operators.common import without_common
from quillmark.operators.instants import normalise_instants
from quillmark.operators.positions import running_totals
from quillmark.operators.similarity import best_of_each, jaccard, rare_containment_pairs
from quillmark.plans import assets as asset_plans
from quillmark.plans import pairs as pair_plans
from quillmark.plans.assets import specific_assets
from quillmark.plans.rankings import _LATEST, latest_drafts
from quillmark.session import materialise
from quillmark.sources.tables import table

#: Evidence similarity up to which a pair rests on its images alone.
VISUAL_EVIDENCE = 0.05


def keyed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two different submissions, the ids in order."""
    return rows.with_pair_key(table(spark, sf_dir, "advanced_pairs"), "a_work_answer_id", "b_work_answer_id").where("low_id < high_id")


def zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0))


def hard_evidence() -> Column:
    """Whether something exact is shared: an object, a file, or named ids."""
    return F.coalesce("exact_object", F.lit(False)) | F.coalesce("exact_file", F.lit(False)) | (F.trim(F.coalesce("exact_shared", F.lit(""))) != "")


def visual_only() -> Column:
    return ~hard_evidence() & (zero("evidence_similarity") <= VISUAL_EVIDENCE)


def report_strength() -> Column:
    """Exactness first, then evidence, then the matched points."""
    exact = F.coalesce("exact_object", F.lit(False)) | F.coalesce("exact_file", F.lit(False))
    return exact.cast("int") * 100000 + zero("evidence_similarity") * 10000 + zero("sift_inliers") + zero("akaze_inliers")


def pair_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair with its verdict, whether its evidence is hard or visual alone, and its strength in a report."""
    p = keyed_pairs(spark, sf_dir)
    return p.select("low_id", "high_id", "verdict", hard_evidence().alias("hard"), visual_only().alias("visual_only"), half_up(report_strength(), 4).alias("strength")).distinct()


def review_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed and suspected pairs on visual grounds alone with many matched points or like images, to be looked
    at again; ``place`` is their order by likeness, then points, then ids."""
    p = keyed_pairs(spark, sf_dir).where(F.col("verdict").isin("confirmed", "suspected") & visual_only())
    p = p.where((zero("sift_inliers") >= 300) | (zero("akaze_inliers") >= 120) | (zero("image_hash_similarity") >= 0.92))
    p = p.select("low_id", "high_id", zero("image_hash_similarity").alias("likeness"), (zero("sift_inliers") + zero("akaze_inliers")).alias("points")).distinct()
    placed = running_totals(p.withColumn("one", F.lit(1)), ["one"], [F.desc("likeness"), F.desc("points"), "low_id", "high_id"], out="place", total=None)
    return placed.drop("one")


def verdict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in the order of a report: confirmed, suspected, the rest; by evidence, points and ids."""
    rank = F.when(F.col("verdict") == "confirmed", 0).when(F.col("verdict") == "suspected", 1).otherwise(2)
    p = keyed_pairs(spark, sf_dir).select("low_id", "high_id", rank.alias("verdict_rank"), zero("evidence_similarity").alias("evidence"), zero("sift_inliers").alias("sift")).distinct()
    placed = running_totals(p.withColumn("one", F.lit(1)), ["one"], ["verdict_rank", F.desc("evidence"), F.desc("sift"), "low_id", "high_id"], out="place", total=None)
    return placed.drop("one")


def pieces_of(name: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one pair merged: the highest evidence, all that is shared; a verdict given by hand counts before others,
    the last in the alphabet where there are several."""
    p = keyed_pairs(spark, sf_dir)
    by_hand = F.max(F.when(F.col("verdict_source") == "manual", F.col("verdict")))
    best = p.groupBy("low_id", "high_id").agg(
        F.max(zero("evidence_similarity")).alias("evidence"),
        F.coalesce(by_hand, F.max("verdict")).alias("verdict"),
        F.coalesce(F.bool_or(F.col("verdict_source") == "manual"), F.lit(False)).alias("by_hand"),
        # a pair has a handful of rows
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pieces_of("shared_evidence"))))), "; ").alias("shared"),
    )
    return best


def reviewed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs judged by the algorithm with the review of the same pair, in either order, where there is one; the
    review's verdict is the applied one.  Of several the last in the alphabet counts."""
    p = keyed_pairs(spark, sf_dir)
    key = ["low_id", "high_id"]
    own = p.where("verdict_source = 'algorithm'").groupBy(*key).agg(F.max("verdict").alias("verdict"))
    review = p.where("verdict_source <> 'algorithm'").groupBy(*key).agg(F.max(F.struct("verdict", "verdict_source")).alias("r"))
    j = own.join(review, key, "left")
    return j.select(*key, "verdict", F.col("r.verdict_source").alias("reviewed_by"), F.coalesce("r.verdict", "verdict").alias("applied"))


def evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by what they share: each exact id, else the pair itself; members, pairs and the strongest pair."""
    p = keyed_pairs(spark, sf_dir)
    cut = F.split(F.coalesce("exact_shared", F.lit("")), "[;,]")
    exact = F.transform(F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit("exact:"), x))
    own = F.array(F.concat(F.lit("pair:"), "low_id", F.lit("|"), "high_id"))
    keyed = p.select("low_id", "high_id", report_strength().alias("strength"), F.explode(F.when(F.size(exact) > 0, exact).otherwise(own)).alias("key"))
    both = keyed.select("key", "low_id", "high_id", "strength", F.explode(F.array("low_id", "high_id")).alias("member"))
    return both.groupBy("key").agg(F.countDistinct("member").alias("members"), (F.count(F.lit(1)) / 2).cast("long").alias("pairs"), half_up(F.max("strength"), 4).alias("strongest"))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs worth comparing, each once, with the rules that propose it: exact matches, like images, like evidence
    and both together among the known pairs; evidence tokens met by rare tokens over all submissions; verdicts by hand."""
    p = keyed_pairs(spark, sf_dir)
    ev, h = zero("evidence_similarity"), zero("image_hash_similarity")
    exact = F.coalesce("exact_object", F.lit(False)) | F.coalesce("exact_file", F.lit(False))
    rules = {
        "exact": exact,
        "images": h >= 0.92,
        "evidence": ev >= 0.75,
        "both": ((ev >= 0.45) & (h >= 0.65)) | ((ev >= 0.40) & (h >= 0.45)),
        "by hand": F.coalesce(F.col("verdict_source") == "manual", F.lit(False)),
    }
    named = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())
    known = p.select("low_id", "high_id", F.explode(named).alias("rule"))
    rare = without_common(materialise(pair_plans.all_evidence(spark, sf_dir), "evidence"), "work_answer_id", "token", 5, 0.2)
    met = rare_containment_pairs(rare, "work_answer_id", "token", 0.75, 3).select(F.col("a").alias("low_id"), F.col("b").alias("high_id"), F.lit("tokens").alias("rule"))
    # A pair has at most one row for each of the six rules.
    return known.union(met).distinct().groupBy("low_id", "high_id").agg(F.array_join(F.array_sort(F.collect_list("rule")), ", ").alias("rules"))


def overall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each known pair with the likeness of its answers, images and evidence, the highest as overall, and the reason;
    pairs of an overall of at least 0.92 or with an exact match."""
    p = keyed_pairs(spark, sf_dir).select("low_id", "high_id").distinct()
    who = p.select(F.explode(F.array("low_id", "high_id")).alias("work_answer_id")).distinct()
    last = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row", "answer_text"), ["work_answer_id"], ["submit_row"])
    text = scalars.bare_text(F.col("answer_text"))
    texts = last.join(who, "work_answer_id", "left_semi").select("work_answer_id", F.when(F.length(text) >= 20, scalars.ngrams(text)).alias("grams"))
    a = specific_assets(spark, sf_dir).join(who, "work_answer_id", "left_semi")
    # One submission has some two hundred assets at most.
    images = a.groupBy("work_answer_id").agg(F.collect_set("object").alias("objects"), F.collect_set("file").alias("files"), F.collect_list(bits(F.col("ahash"))).alias("codes"))
    rare = without_common(materialise(pair_plans.all_evidence(spark, sf_dir), "evidence"), "work_answer_id", "token", 5, 0.2)
    tokens = rare.where("token is not null").join(who, "work_answer_id", "left_semi").groupBy("work_answer_id").agg(F.collect_set("token").alias("tokens"))
    none = F.array().cast("array<string>")
    each = who.join(texts, "work_answer_id", "left").join(images, "work_answer_id", "left").join(tokens, "work_answer_id", "left")
    each = each.select(
        "work_answer_id",
        "grams",
        *[F.coalesce(c, none).alias(c) for c in ("objects", "files", "tokens")],
        F.coalesce("codes", F.array().cast("array<bigint>")).alias("codes"),
    )
    sides = [each.select(*[F.col(c).alias(f"{c}_{s}") for c in each.columns]) for s in "xy"]
    j = p.join(sides[0], F.col("low_id") == F.col("work_answer_id_x")).join(sides[1], F.col("high_id") == F.col("work_answer_id_y"))
    both = lambda c: F.size(F.array_intersect(f"{c}_x", f"{c}_y"))
    j = j.withColumns({"object_overlap": both("objects"), "file_overlap": both("files"), "shared": both("tokens")})
    j = j.withColumn("text", F.when(F.col("grams_x").isNotNull() & F.col("grams_y").isNotNull(), jaccard(F.col("grams_x"), F.col("grams_y"))).otherwise(0.0))
    has_codes = (F.size("codes_x") > 0) & (F.size("codes_y") > 0)
    best = best_of_each(F.col("codes_x"), F.col("codes_y"))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)
    exact = (F.col("object_overlap") > 0) | (F.col("file_overlap") > 0)
    j = j.withColumn("image", F.when(exact, 1.0).when(has_codes, mean).otherwise(0.0))
    least = F.least(F.size("tokens_x"), F.size("tokens_y"))
    j = j.withColumn("evidence", F.when(least >= 3, F.col("shared") / least).otherwise(0.0))
    reason = (
        F.when(F.col("object_overlap") > 0, "same object")
        .when(F.col("file_overlap") > 0, "same file")
        .when(has_codes, "like images")
        .when(F.col("evidence") >= 0.7, "like evidence")
        .when(F.col("text") >= 0.85, "like text")
        .otherwise("")
    )
    out = j.select(
        "low_id", "high_id", half_up(F.greatest("text", "image", "evidence"), 4).alias("overall"), half_up(F.col("text"), 4).alias("text"),
        half_up(F.col("image"), 4).alias("image"), half_up(F.col("evidence"), 4).alias("evidence"), F.col("object_overlap").cast("long").alias("object_overlap"),
        F.col("file_overlap").cast("long").alias("file_overlap"), reason.alias("reason"),
    )
    return out.where("overall >= 0.92 or object_overlap > 0 or file_overlap > 0")


def nearest_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a submission's pairs the one of the highest overall whose other side is completed and has a score; taken
    only if that overall is at least 0.95.  Ties go to the smaller id."""
    o = overall_pairs(spark, sf_dir).select("low_id", "high_id", "overall")
    s = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row", "status", "existing_score"), ["work_answer_id"], ["submit_row"])
    graded = s.where(rows.completed(F.col("status"))).select(F.col("work_answer_id").alias("other"), scalars.leading_number(F.col("existing_score")).alias("score")).where("score is not null")
    sides = rows.both_sides(o, "low_id", "high_id", "overall").join(graded, "other")
    best = sides.groupBy(F.col("me").alias("work_answer_id")).agg(F.min(F.struct((-F.col("overall")).alias("o"), "other", "score")).alias("b"))
    return best.select("work_answer_id", F.col("b.other").alias("graded"), (-F.col("b.o")).alias("overall"), F.col("b.score").alias("score")).where("overall >= 0.95")


def timed_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each submission with the instant of its submit time; no instant counts as time 0."""
    cols = ["work_answer_id", "submit_row", "student_no", "submit_time", "campus_tz", "collected_at"]
    last = rows.last_by(table(spark, sf_dir, "submissions").where("work_answer_id is not null").select(*cols), ["work_answer_id"], ["submit_row"])
    timed = normalise_instants(last, "submit_time", "campus_tz", "collected_at")
    return timed.select("work_answer_id", F.coalesce("student_no", F.lit("")).alias("student_no"), F.coalesce("utc_ms", F.lit(0)).alias("at"))


def direct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each submission the source among its confirmed partners submitted no later: the earliest by submit
    instant, then the strongest, then the smaller student number and id."""
    p = keyed_pairs(spark, sf_dir).where("verdict = 'confirmed'").withColumn("strength", half_up(pair_plans.strength(), 4))
    s = materialise(timed_submissions(spark, sf_dir), "timed")
    sides = rows.both_sides(p, "low_id", "high_id", "strength")
    j = sides.join(s.select(F.col("work_answer_id").alias("me"), F.col("at").alias("my_at")), "me").join(s.toDF("other", "student_no", "at"), "other").where("at <= my_at")
    best = j.groupBy(F.col("me").alias("work_answer_id")).agg(F.min(F.struct("at", (-F.col("strength")).alias("s"), "student_no", "other")).alias("b"))
    return best.select("work_answer_id", F.col("b.other").alias("source"), F.col("b.at").alias("source_ms"))


def later_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed pairs, the earlier submission first: by submit instant, then student number, then id; and whether
    their evidence is hard in any row."""
    p = keyed_pairs(spark, sf_dir).where(F.col("verdict") == "confirmed").groupBy("low_id", "high_id").agg(F.bool_or(hard_evidence()).alias("hard"))
    s = materialise(timed_submissions(spark, sf_dir), "timed")
    x, y = s.toDF("low_id", "no_x", "at_x"), s.toDF("high_id", "no_y", "at_y")
    j = p.join(x, "low_id").join(y, "high_id")
    key = lambda at, no, i: F.struct(F.col(at).alias("at"), F.col(no).alias("no"), F.col(i).alias("id"))
    a, b = key("at_x", "no_x", "low_id"), key("at_y", "no_y", "high_id")
    return j.select(F.least(a, b)["id"].alias("first"), F.greatest(a, b)["id"].alias("later"), "hard")


def submit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of submission within assignment and class among scored drafts, by submit instant, as position and share."""
    d = latest_drafts(spark, sf_dir).where("score > 0").select("work_answer_id", "assignment_id", "cls")
    s = timed_submissions(spark, sf_dir)
    out = rows.position_share(d.join(s, "work_answer_id"), ["assignment_id", "cls"], ["at", "student_no", "work_answer_id"])
    return out.select("work_answer_id", "assignment_id", "cls", "at", "position", half_up(F.col("share"), 6).alias("share"))


def raw_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students of a class ranked by their total as it is, not rounded; decimals, so that equal totals tie."""
    d = latest_drafts(spark, sf_dir)
    per = d.groupBy("cls", "student").agg(F.sum(F.col("score").cast("decimal(12,6)")).alias("exact"))
    return rows.competition_rank(per, ["cls"], F.col("exact"), "place").select("cls", "student", F.col("exact").cast("double").alias("total"), "place")


def first_real_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first downloaded image of each submission that isn't a common one, and the size of its largest."""
    a = table(spark, sf_dir, "assets").where("ok").withColumn("oid", asset_ops.real_object_id(F.col("object_id"), F.col("src")))
    rare = without_common(a, "work_answer_id", "oid")
    order = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("question_index", "image_index")], F.coalesce("file_name", F.lit("")).alias("file_name"))
    return rare.groupBy("work_answer_id").agg(F.min(order)["file_name"].alias("file_name"), F.greatest(F.lit(0), F.max("n_bytes")).alias("largest"))


def fresh_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last vision result of each submission and whether it holds for the present files: the images it used are
    all of those downloaded, or the first six by name; a result without a score never does."""
    v = rows.last_by(table(spark, sf_dir, "vision").where("work_answer_id is not null").select("work_answer_id", "vision_id", "used_images", "score"), ["work_answer_id"], ["vision_id"])
    a = table(spark, sf_dir, "assets").where("ok and file_name is not null")
    now = a.groupBy("work_answer_id").agg(F.array_sort(F.collect_set("file_name")).alias("files"))
    j = v.join(now, "work_answer_id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    used = F.array_sort(F.coalesce("used_images", F.array().cast("array<string>")))
    same = (used == F.col("files")) | (used == F.slice("files", 1, 6))
    return j.select("work_answer_id", "vision_id", (F.col("score").isNotNull() & same).alias("fresh"), F.size("files").cast("long").alias("files"))


def stale_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions to be looked at (again): those without a fresh vision result."""
    s = table(spark, sf_dir, "submissions").select("work_answer_id").where("work_answer_id is not null").distinct()
    return s.join(fresh_reviews(spark, sf_dir).where("fresh"), "work_answer_id", "left_anti")


def rescoring_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions chosen before scoring: pending ones, and those whose present score is 60 or more."""
    s = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row", "status", "existing_score"), ["work_answer_id"], ["submit_row"])
    waiting, good = rows.pending(F.col("status")), scalars.number(F.col("existing_score")) >= 60
    return s.where(waiting | good).select("work_answer_id", waiting.alias("pending"), good.alias("scored"))


def evidence_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many evidence tokens each submission shows in all its texts, and in those that were observed (the
    extracted text and the answer) alone."""
    v = rows.last_by(table(spark, sf_dir, "vision").where("work_answer_id is not null"), ["work_answer_id"], ["vision_id"])
    s = rows.last_by(table(spark, sf_dir, "submissions").where("work_answer_id is not null").select("work_answer_id", "submit_row", "answer_text"), ["work_answer_id"], ["submit_row"])
    j = v.select("work_answer_id", "extracted_text", "summary", "review_comment").join(s.select("work_answer_id", "answer_text"), "work_answer_id", "full")
    n = lambda *cols: F.size(extract.reference_tokens(F.concat_ws("\n", *cols))).cast("long")
    return j.select("work_answer_id", n("extracted_text", "summary", "review_comment", "answer_text").alias("in_all"), n("extracted_text", "answer_text").alias("observed"))


def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness values as texts of at most four places without closing zeros."""
    p = table(spark, sf_dir, "advanced_pairs")
    return p.groupBy(scalars.metric("evidence_similarity").alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


def display_days(spark: SparkSession, sf_dir: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """Collected rows by the day and hour that a reader in ``zone`` sees."""
    s = table(spark, sf_dir, "submissions")
    return s.groupBy(F.date_format(F.from_utc_timestamp("collected_at", zone), "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def assignment_pick(spark: SparkSession, sf_dir: str, title: str | None = "三", index: int | None = None) -> DataFrame:
    """One assignment: the first whose title holds ``title``, else the one at ``index``, else the first; by key."""
    a = table(spark, sf_dir, "assignments")
    order = F.struct(F.length("assignment_key").alias("l"), "assignment_key")
    if title:
        a, index = a.where(F.col("title").contains(title)), 0
    placed = running_totals(a.withColumns({"one": F.lit(1), "o": order}), ["one"], ["o"], out="place", total=None)
    return placed.where(F.col("place") == (index or 0) + 1).select("assignment_id", "assignment_key", "title")


def cleaned_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft comments read as HTML, without replacement characters, blanks squeezed, of 500 characters at most."""
    c = scalars.cleaned_comment(F.col("draft_comment"))
    return table(spark, sf_dir, "drafts").select("draft_id", F.md5(c.cast("binary")).alias("comment"), F.length(c).cast("long").alias("chars"))


def path_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and paths in the extracted texts, repaired, by how many results show them."""
    v = table(spark, sf_dir, "vision").select("vision_id", F.explode(extract.paths_in(F.col("extracted_text"))).alias("path"))
    return v.groupBy("path").agg(F.count(F.lit(1)).alias("results"))


def shell_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of uploaded shells in the last vision result of each submission: those of its own and the weak ones."""
    v = rows.last_by(table(spark, sf_dir, "vision").where("work_answer_id is not null").select("work_answer_id", "vision_id", "extracted_text"), ["work_answer_id"], ["vision_id"])
    s = rows.last_by(table(spark, sf_dir, "submissions").select("work_answer_id", "submit_row", "student_no"), ["work_answer_id"], ["submit_row"])
    j = v.select("work_answer_id", extract.shell_pieces(F.col("extracted_text")).alias("pieces")).where(F.size("pieces") > 0).join(s, "work_answer_id", "left")
    strong = F.filter("pieces", lambda x: extract.strong_piece(x, F.col("student_no")))
    weak = F.filter("pieces", lambda x: ~extract.strong_piece(x, F.col("student_no")))
    address = F.exists("pieces", lambda x: x.rlike(r"https?:|(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}|localhost:\d{2,5}"))
    return j.select("work_answer_id", F.array_join(strong, "; ").alias("strong"), F.array_join(weak, "; ").alias("weak"), address.alias("address"))


def rubric_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each document read as a rubric: lines and characters."""
    kept = extract.rubric_lines(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", kept.alias("kept"))
    return d.select("doc_id", F.size("kept").cast("long").alias("lines"), F.length(F.array_join("kept", "\n")).cast("long").alias("chars"))


def student_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students of the drafts in the order of Chinese collation by class, name and number."""
    d = table(spark, sf_dir, "drafts").select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("class_name", "student_name", "student_no")]).distinct()
    keys = [F.collate(F.col(c), "zh_Hans_CHN") for c in ("class_name", "student_name")]
    placed = running_totals(d.withColumn("one", F.lit(1)), ["one"], [*keys, "student_no"], out="place", total=None)
    return placed.drop("one")


QUERIES = {
    f.__name__: f
    for f in (
        pair_flags,
        review_selection,
        verdict_order,
        merged_evidence,
        reviewed_pairs,
        evidence_keys,
        candidate_pairs,
        overall_pairs,
        nearest_graded,
        direct_sources,
        later_of_pairs,
        submit_positions,
        raw_rank,
        first_real_image,
        fresh_reviews,
        stale_submissions,
        rescoring_subset,
        evidence_variants,
        metric_texts,
        display_days,
        assignment_pick,
        cleaned_comments,
        path_lists,
        shell_evidence,
        rubric_excerpts,
        student_order,
    )
}

_P = """p as (select *, least(trim(a_work_answer_id), trim(b_work_answer_id)) low_id, greatest(trim(a_work_answer_id), trim(b_work_answer_id)) high_id,
  coalesce(evidence_similarity, 0) ev, coalesce(image_hash_similarity, 0) h, coalesce(sift_inliers, 0) si, coalesce(akaze_inliers, 0) ai,
  coalesce(exact_object, false) or coalesce(exact_file, false) exact from advanced_pairs where trim(a_work_answer_id) <> trim(b_work_answer_id)),
f as (select *, exact or trim(coalesce(exact_shared, ''), ' ') <> '' hard, exact::int * 100000 + ev * 10000 + si + ai points from p)"""
_LAST = "last as (select * from submissions where work_answer_id is not null qualify row_number() over (partition by work_answer_id order by submit_row desc) = 1)"
_RARE = f"""{pair_plans._ALL_EVIDENCE}, nt as (select count(*) n from t),
common as (select token from k, nt group by token, nt.n having count(*) >= 5 and count(*) >= 0.2 * nt.n),
r as (select *, count(*) over (partition by w) size from k where token not in (select token from common))"""

_OVERALL = rf"""{_P}, {_RARE}, {asset_plans._SPECIFIC},
{_LAST},
tx as (select work_answer_id w, lower(regexp_replace(coalesce(answer_text, ''), '{pair_plans._WS}|[，。；：,.!?！？、]', '', 'g')) t from last),
g as (select w, case when length(t) >= 20 then list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) end grams from tx),
im as (select w, list_distinct(list("object") filter ("object" is not null)) objects, list_distinct(list(file) filter (file is not null)) files,
  list(ahash) filter (regexp_full_match(ahash, '[01]{{64}}')) codes from kept group by w),
tk as (select w, list(token) tokens from r group by w),
o as (select distinct low_id, high_id from p),
j as (select o.*, ga.grams gx, gb.grams gy, coalesce(ia.objects, []) ox, coalesce(ib.objects, []) oy, coalesce(ia.files, []) fx, coalesce(ib.files, []) fy,
    coalesce(ia.codes, []) cx, coalesce(ib.codes, []) cy, coalesce(ta.tokens, []) kx, coalesce(tb.tokens, []) ky
  from o left join g ga on ga.w = low_id left join g gb on gb.w = high_id left join im ia on ia.w = low_id left join im ib on ib.w = high_id
  left join tk ta on ta.w = low_id left join tk tb on tb.w = high_id),
q as (select low_id, high_id, len(list_intersect(ox, oy)) object_overlap, len(list_intersect(fx, fy)) file_overlap,
  case when gx is not null and gy is not null then len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy))) else 0 end tsim,
  case when least(len(kx), len(ky)) >= 3 then len(list_intersect(kx, ky)) / least(len(kx), len(ky)) else 0 end esim, len(cx) > 0 and len(cy) > 0 coded,
  list_transform(case when len(cx) <= len(cy) then cx else cy end, lambda a: list_max(list_transform(case when len(cx) <= len(cy) then cy else cx end,
    lambda b: 1 - hamming(a, b) / 64))) likes from j),
z as (select *, case when object_overlap > 0 or file_overlap > 0 then 1.0 when coded then list_sum(likes) / len(likes) else 0.0 end isim from q),
overall as (select low_id, high_id, floor(greatest(tsim, isim, esim) * 10000 + 0.5) / 10000 overall, floor(tsim * 10000 + 0.5) / 10000 "text",
  floor(isim * 10000 + 0.5) / 10000 image, floor(esim * 10000 + 0.5) / 10000 evidence, object_overlap, file_overlap,
  case when object_overlap > 0 then 'same object' when file_overlap > 0 then 'same file' when coded then 'like images' when esim >= 0.7 then 'like evidence'
    when tsim >= 0.85 then 'like text' else '' end reason from z)"""

SQL = {
    "pair_flags": f"with {_P} select distinct low_id, high_id, verdict, hard, not hard and ev <= 0.05 visual_only, floor(points * 10000 + 0.5) / 10000 strength from f",
    "review_selection": f"""with {_P}, s as (select distinct low_id, high_id, h likeness, si + ai points from f
  where verdict in ('confirmed', 'suspected') and not hard and ev <= 0.05 and (si >= 300 or ai >= 120 or h >= 0.92))
select *, row_number() over (order by likeness desc, points desc, low_id, high_id) place from s""",
    "verdict_order": f"""with {_P}, s as (select distinct low_id, high_id, case verdict when 'confirmed' then 0 when 'suspected' then 1 else 2 end verdict_rank, ev evidence, si sift from p)
select *, row_number() over (order by verdict_rank, evidence desc, sift desc, low_id, high_id) place from s""",
    "merged_evidence": f"""with {_P} select low_id, high_id, max(ev) evidence, coalesce(max(verdict) filter (verdict_source = 'manual'), max(verdict)) verdict,
  coalesce(bool_or(verdict_source = 'manual'), false) by_hand,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list(string_split(coalesce(shared_evidence, ''), ';'))), lambda x: trim(x)), lambda x: x <> ''))), '; ') shared
from p group by 1, 2""",
    "reviewed_pairs": f"""with {_P}, own as (select low_id, high_id, max(verdict) verdict from p where verdict_source = 'algorithm' group by 1, 2),
rv as (select low_id, high_id, verdict, verdict_source from p where verdict_source <> 'algorithm' qualify row_number() over (partition by low_id, high_id order by verdict desc, verdict_source desc) = 1)
select own.low_id, own.high_id, own.verdict, rv.verdict_source reviewed_by, coalesce(rv.verdict, own.verdict) applied from own left join rv on rv.low_id = own.low_id and rv.high_id = own.high_id""",
    "evidence_keys": f"""with {_P}, e as (select *, list_filter(list_transform(string_split_regex(coalesce(exact_shared, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '') x from f),
k as (select low_id, high_id, points, unnest(case when len(x) > 0 then list_transform(x, lambda y: 'exact:' || y) else ['pair:' || low_id || '|' || high_id] end) as "key" from e),
m as (select "key", low_id member from k union select "key", high_id from k), c as (select "key", count(*) members from m group by 1)
select k."key", members, count(*) pairs, floor(max(points) * 10000 + 0.5) / 10000 strongest from k join c on c."key" = k."key" group by 1, 2""",
    "candidate_pairs": f"""with {_P}, {_RARE},
met as (select a.w low_id, b.w high_id from r a join r b using (token) where a.w < b.w and a.size >= 3 and b.size >= 3 group by a.w, b.w, a.size, b.size
  having floor(count(*) / least(a.size, b.size) * 10000 + 0.5) / 10000 >= 0.75),
c as (select low_id, high_id, 'exact' rule from p where exact union select low_id, high_id, 'images' from p where h >= 0.92
  union select low_id, high_id, 'evidence' from p where ev >= 0.75 union select low_id, high_id, 'both' from p where (ev >= 0.45 and h >= 0.65) or (ev >= 0.4 and h >= 0.45)
  union select low_id, high_id, 'by hand' from p where verdict_source = 'manual' union select low_id, high_id, 'tokens' from met)
select low_id, high_id, string_agg(rule, ', ' order by rule) rules from c group by 1, 2""",
    "overall_pairs": f"with {_OVERALL} select * from overall where overall >= 0.92 or object_overlap > 0 or file_overlap > 0",
    "nearest_graded": rf"""with {_OVERALL}, okay as (select * from overall where overall >= 0.92 or object_overlap > 0 or file_overlap > 0),
gr as (select work_answer_id other, try_cast(nullif(regexp_extract(existing_score, '^\s*([-+]?(?:\d+\.?\d*|\.\d+))', 1), '') as double) score from last where regexp_matches(status, '已完成|已批')),
sd as (select low_id me, high_id other, overall from okay union all select high_id, low_id, overall from okay),
b as (select me, sd.other, overall, score from sd join gr on gr.other = sd.other where score is not null qualify row_number() over (partition by me order by overall desc, sd.other) = 1)
select me work_answer_id, other graded, overall, score from b where overall >= 0.95""",
    "raw_rank": f"""with {_LATEST}, per as (select cls, student, sum(score::decimal(12, 6)) exact from latest group by 1, 2)
select cls, student, exact::double total, rank() over (partition by cls order by exact desc)::int place from per""",
    "first_real_image": f"""with x as (select *, {asset_plans._OID} oid from assets where ok), n as (select count(distinct work_answer_id) n from x),
common as (select oid from x, n where oid is not null group by oid, n.n having count(distinct work_answer_id) >= 5 and count(distinct work_answer_id) >= 0.2 * n.n),
r as (select * from x where not coalesce(oid in (select oid from common), false))
select work_answer_id, arg_min(coalesce(file_name, ''), (coalesce(question_index, 0), coalesce(image_index, 0), coalesce(file_name, ''))) file_name,
  greatest(0, max(n_bytes)) largest from r group by 1""",
    "fresh_reviews": """with v as (select * from vision where work_answer_id is not null qualify row_number() over (partition by work_answer_id order by vision_id desc) = 1),
a as (select work_answer_id, list_sort(list_distinct(list(file_name))) files from assets where ok and file_name is not null group by 1),
j as (select v.work_answer_id, vision_id, score, list_sort(coalesce(used_images, [])) used, coalesce(files, []) fs from v left join a on a.work_answer_id = v.work_answer_id)
select work_answer_id, vision_id, score is not null and (used = fs or used = fs[1:6]) fresh, len(fs) files from j""",
    "rescoring_subset": f"""with {_LAST}, s as (select work_answer_id, coalesce(regexp_matches(status, '待批阅|重做待批阅|批阅') and not regexp_matches(status, '已完成|已批|查看'), false) pending,
  coalesce(try_cast(trim(existing_score) as double), 0) >= 60 scored from submissions qualify row_number() over (partition by work_answer_id order by submit_row desc) = 1)
select * from s where pending or scored""",
    "evidence_variants": f"""with {pair_plans._ALL_EVIDENCE}, {pair_plans._evidence("extracted_text, answer_text", "2")},
c as (select w, count(*) n from k group by 1), c2 as (select w, count(*) n from k2 group by 1)
select t.w work_answer_id, coalesce(c.n, 0) in_all, coalesce(c2.n, 0) observed from t left join c on c.w = t.w left join c2 on c2.w = t.w""",
    "metric_texts": r"""select case when evidence_similarity is null or isnan(evidence_similarity) then '' else regexp_replace(regexp_replace(printf('%.4f', evidence_similarity), '0+$', ''), '\.$', '') end evidence,
  count(*) n from advanced_pairs group by 1""",
    "display_days": "select strftime(collected_at at time zone 'Asia/Shanghai', '%Y-%m-%d %H') as \"hour\", count(*) n from submissions group by 1",
    "assignment_pick": "select assignment_id, assignment_key, title from assignments where contains(title, '三') order by length(assignment_key), assignment_key limit 1",
    "cleaned_comments": rf"""with a as (select draft_id, regexp_replace(regexp_replace(coalesce(draft_comment, ''), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') s from drafts),
b as (select draft_id, regexp_replace(regexp_replace(s, '(?i)</(h[1-6]|p|div|li|tr|pre|code)>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') s from a),
c as (select draft_id, replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', '''') s from b),
d as (select draft_id, regexp_replace(replace(regexp_replace(regexp_replace(s, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(65533), ''), '[\t\f \x{{000b}}\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g') s from c),
e as (select draft_id, substr(regexp_replace(s, '^{pair_plans._WS}+|{pair_plans._WS}+$', '', 'g'), 1, 500) s from d)
select draft_id, md5(s) comment, length(s) chars from e""",
}
SQL["stale_submissions"] = f"with fr as ({SQL['fresh_reviews']}) select distinct work_answer_id from submissions where work_answer_id is not null and work_answer_id not in (select work_answer_id from fr where fresh)"
