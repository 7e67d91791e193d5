"""Similarity joins: exact blocking, then verification.

* Set similarity by prefix filter: with the values ordered from rare to frequent, two sets at or above the
  threshold share a value among the first |x| - ceil(t |x|) + 1 of each.
* Hamming distance by pigeonhole: codes within distance d differ by at most one bit in one of
  ceil((d + 1) / 2) blocks.
* Containment by the inverted index over values that aren't common.

No pair above the threshold is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.scalars import bare_text, half_up, hamming, ngrams


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    united = F.size(a) + F.size(b) - shared
    return F.when(united > 0, shared / united).otherwise(0.0)


def pairs_of_equals(members: DataFrame, cls: str, ident: str, block: int = 1000) -> DataFrame:
    """(x, y) for each two members of a class, x < y.  A class of more than ``block`` members is cut into blocks by
    the member's hash and blocks meet, so that a task writes the pairs of two blocks, however large the class."""
    sizes = members.groupBy(cls).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__of"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    placed = members.join(sizes, cls).select(cls, F.col(ident).alias("__m"), "__of", F.pmod(F.xxhash64(ident), F.col("__of")).cast("int").alias("__k"))
    left = placed.select(cls, F.col("__m").alias("x"), "__k", F.explode(F.sequence(F.col("__k"), F.col("__of") - 1)).alias("__j"))
    right = placed.select(cls, F.col("__m").alias("y"), F.col("__k").alias("__j"), F.explode(F.sequence(F.lit(0), F.col("__k"))).alias("__k"))
    met = left.join(right, [cls, "__k", "__j"]).where("x <> y and (__k < __j or x < y)")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def text_pairs(docs: DataFrame, ident: str, text: str, within: list[str], threshold: float, least: int = 20) -> DataFrame:
    """(a, b, text_similarity) with a < b for texts in the same ``within`` group whose sets of character
    3-grams reach ``threshold`` after rounding to four places; texts under ``least`` characters have none."""
    t = threshold - 0.00005
    own = [F.col(c).alias(f"w{k}") for k, c in enumerate(within)]
    within = [f"w{k}" for k in range(len(within))]
    bare = docs.select(F.col(ident).alias("id"), *own, bare_text(F.col(text)).alias("t")).where(F.length("t") >= least)
    sets = bare.select("id", *within, ngrams(F.col("t")).alias("grams")).withColumn("n", F.size("grams"))
    # Equal texts are one class; only classes meet, members come back at the end.
    keyed = sets.withColumn("cls", F.xxhash64(*within, F.array_sort("grams")))
    classes = keyed.groupBy("cls").agg(*[F.first(c).alias(c) for c in (*within, "grams", "n")])
    long = classes.select("cls", *within, "n", F.explode("grams").alias("g"))
    freq = long.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    order = F.row_number().over(Window.partitionBy("cls").orderBy("df", "g"))
    first = long.join(freq, "g").withColumn("k", order).where(F.col("k") <= F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1)
    a, b = first.alias("a"), first.alias("b")
    on = (F.col("a.g") == F.col("b.g")) & (F.col("a.cls") < F.col("b.cls"))
    for c in within:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    on = on & (F.col("b.n") >= t * F.col("a.n")) & (F.col("a.n") >= t * F.col("b.n"))
    near = a.join(b, on).select(F.col("a.cls").alias("ca"), F.col("b.cls").alias("cb")).distinct()
    near = near.join(classes.select(F.col("cls").alias("ca"), F.col("grams").alias("ga")), "ca")
    near = near.join(classes.select(F.col("cls").alias("cb"), F.col("grams").alias("gb")), "cb")
    near = near.withColumn("text_similarity", half_up(jaccard(F.col("ga"), F.col("gb")), 4)).where(F.col("text_similarity") >= threshold)
    who = keyed.select("cls", "id")
    between = near.join(who.toDF("ca", "x"), "ca").join(who.toDF("cb", "y"), "cb").select("x", "y", "text_similarity")
    same = pairs_of_equals(who, "cls", "id").select("x", "y", F.lit(1.0).alias("text_similarity"))
    return between.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "text_similarity")


def code_pairs(codes: DataFrame, code: str, distance: int) -> DataFrame:
    """(a, b, distance) for distinct 64-bit codes at most ``distance`` apart, a < b.

    Half as many blocks as there are differing bits and one, each twice as long: in one of them two such codes
    differ by one bit at most, so that one side brings each block also with each of its bits changed.  At a
    distance of 5 a block has 21 bits, two million buckets in place of some thousand."""
    blocks = (distance + 2) // 2
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    x = codes.select(F.col(code).alias("c")).where("c is not null").distinct()
    pieces = [F.shiftrightunsigned(F.shiftleft("c", edges[k]), 64 - edges[k + 1] + edges[k]) for k in range(blocks)]
    keyed = x.select("c", F.posexplode(F.array(*pieces)).alias("k", "piece"))
    widths = F.array(*[F.lit(edges[k + 1] - edges[k]) for k in range(blocks)])
    one_off = F.transform(F.sequence(F.lit(0), F.get(widths, F.col("k")) - 1), lambda i: F.col("piece").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    own = F.array(F.col("piece"))
    b = keyed.select("c", "k", F.explode(F.concat(own, one_off) if distance else own).alias("piece")).alias("b")
    a = keyed.alias("a")
    d = hamming(F.col("a.c"), F.col("b.c"))
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.c") < F.col("b.c")) & (d <= distance)
    return a.join(b, on).select(F.col("a.c").alias("a"), F.col("b.c").alias("b"), d.alias("distance")).distinct()


def containment_pairs(tokens: DataFrame, record: str, token: str, threshold: float, least: int = 3) -> DataFrame:
    """(a, b, shared, containment): shared tokens over the smaller set, both sets of at least ``least``."""
    seen = tokens.select(F.col(record).alias("r"), F.col(token).alias("v")).where("r is not null and v is not null").distinct()
    sizes = seen.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = seen.join(sizes, "r")
    a, b = kept.toDF("a", "v", "na"), kept.toDF("b", "v", "nb")
    met = a.join(b, "v").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    share = half_up(F.col("shared") / F.least("na", "nb"), 4)
    return met.withColumn("containment", share).where(F.col("containment") >= threshold).select("a", "b", "shared", "containment")


def rare_containment_pairs(tokens: DataFrame, record: str, token: str, threshold: float, least: int = 3) -> DataFrame:
    """The rows of ``containment_pairs`` with fewer meetings: the smaller set meets others by its rarest tokens only.

    A pair at the threshold shares ceil(t n) of the n tokens of the smaller set, so one of any n - ceil(t n) + 1.
    """
    t = threshold - 0.00005
    seen = tokens.select(F.col(record).alias("r"), F.col(token).alias("v")).where("r is not null and v is not null").distinct()
    sets = seen.groupBy("r").agg(F.collect_list("v").alias("vs")).withColumn("n", F.size("vs")).where(F.col("n") >= least)
    long = sets.select("r", "n", F.explode("vs").alias("v"))
    freq = long.groupBy("v").agg(F.count(F.lit(1)).alias("df"))
    at = F.row_number().over(Window.partitionBy("r").orderBy("df", "v"))
    first = long.join(freq, "v").withColumn("k", at).where(F.col("k") <= F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1)
    a, b = first.select(F.col("r").alias("x"), F.col("n").alias("nx"), "v"), long.toDF("y", "ny", "v")
    met = a.join(b, "v").where("x <> y and nx <= ny").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    both = met.join(sets.toDF("a", "va", "na"), "a").join(sets.toDF("b", "vb", "nb"), "b").withColumn("shared", F.size(F.array_intersect("va", "vb")).cast("long"))
    share = half_up(F.col("shared") / F.least("na", "nb"), 4)
    return both.withColumn("containment", share).where(F.col("containment") >= threshold).select("a", "b", "shared", "containment")


def best_of_each(a: Column, b: Column) -> Column:
    """For each 64-bit code of the shorter list (the first where equal), the highest likeness to one of the other."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return F.transform(short, lambda x: F.array_max(F.transform(long, lambda y: 1 - hamming(x, y) / 64)))


def best_match_mean(pairs: DataFrame, hashes: DataFrame, a: str, b: str, record: str, code: str) -> DataFrame:
    """(a, b, mean_best, best) for given pairs of records: for each code of the record with fewer (the first
    where equal), the highest likeness 1 - distance / 64 to the other's codes; their mean, and the best of all.

    Codes of common values should be left out before, so that no record has very many."""
    h = hashes.select(F.col(record).alias("r"), F.col(code).alias("c")).where("c is not null").distinct()
    h = h.groupBy("r").agg(F.collect_list("c").alias("cs"))
    p = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    p = p.join(h.toDF("a", "ca"), "a").join(h.toDF("b", "cb"), "b")
    out = p.withColumn("likeness", best_of_each(F.col("ca"), F.col("cb")))
    mean = F.aggregate("likeness", F.lit(0.0), lambda s, x: s + x) / F.size("likeness")
    return out.select("a", "b", half_up(mean, 4).alias("mean_best"), half_up(F.array_max("likeness"), 4).alias("best"))


def average_hash(values: Column) -> Column:
    """64 grey values to 64 bits, 1 where a value reaches the mean; null for fewer."""
    total = F.aggregate(F.slice(values, 1, 64), F.lit(0.0), lambda s, x: s + x.cast("double"))
    bit = F.transform(F.slice(values, 1, 64), lambda x: F.when(x.cast("double") * 64 >= total, "1").otherwise("0"))
    return F.when(F.size(values) >= 64, F.array_join(bit, ""))


def ratio_matches(points: DataFrame, ident: str, vector: str, image: str, ratio: float = 0.75) -> DataFrame:
    """kNN-2 ratio test between the images' vectors: (from_id, to_id, distance, ratio) where the nearest vector
    of another image is nearer than ``ratio`` times the second nearest.

    The queries are every hundredth id, against all rows.
    """
    q = points.where(F.col(ident) % 100 == 0).select(F.col(ident).alias("from_id"), F.col(vector).alias("u"), F.col(image).alias("i"))
    p = points.select(F.col(ident).alias("to_id"), F.col(vector).alias("v"), F.col(image).alias("j"))
    square = F.aggregate(F.zip_with("u", "v", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    d = q.join(p, F.col("i") != F.col("j")).select("from_id", F.sqrt(square).alias("d"), "to_id")
    # Each task keeps but two rows of a query before the shuffle (a limit on the rank in the window), so that the
    # window gets at most twice as many rows of a query as there are tasks.
    at = F.row_number().over(Window.partitionBy("from_id").orderBy("d", "to_id"))
    two = d.withColumn("at", at).where("at <= 2").groupBy("from_id").agg(F.array_sort(F.collect_list(F.struct("d", "to_id"))).alias("two"))
    near = two.where(F.size("two") == 2)
    share = F.col("two")[0]["d"] / F.col("two")[1]["d"]
    return near.select("from_id", F.col("two")[0]["to_id"].alias("to_id"), half_up(F.col("two")[0]["d"], 4).alias("distance"), half_up(share, 4).alias("ratio")).where(share < ratio)
