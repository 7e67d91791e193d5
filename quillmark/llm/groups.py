"""Pairwise matches consolidated into groups: hash-to-min.

Each vertex keeps a cluster, held as rows (vertex, member).  In a round it sends its cluster to the
cluster's least member and that member to all others; when nothing changes, the least member of a
component holds the whole component and every other vertex holds just that member.  The number of
rounds grows with the logarithm of the longest chain.

Clusters are rows, never arrays, so that a component of any size spreads over the tasks.  The least member
and the size of each cluster come from one aggregation, which combines before its shuffle.  A vertex with
more than ``HOT`` members gets its least member by a broadcast, so that its rows are never shuffled by the
vertex; there are at most rows / HOT such vertices.  All others meet theirs in the join by vertex.  A round
has three exchanges, is written as Parquet (the next one is planned with its true size) and counts itself
while it is written.

Cases: a null end or a pair of equal ends links nothing; repeated and reversed pairs count once; an empty
table gives no rows; ids compare as stored text or numbers, the group is the least of its ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillmark.session import drop_written, materialise

#: Rows of one vertex beyond which they aren't shuffled by the vertex.
HOT = 50_000


def sent_clusters(clusters: DataFrame, hot: int = 0) -> DataFrame:
    """The clusters (v, u) after a round of messages; ``hot`` is ``HOT`` unless given."""
    hot = hot or HOT
    least = clusters.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    large = F.broadcast(least.where(F.col("n") > hot).select("v", "m"))
    small = least.where(F.col("n") <= hot).select("v", "m")
    # The rows of a large cluster stay where they are; those of the others meet the least member by vertex.
    rows = clusters.join(large, "v", "left")
    met = [rows.where("m is not null"), rows.where("m is null").select("v", "u").join(small, "v")]
    both = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
    return reduce(DataFrame.union, [x.select(F.inline(both)) for x in met]).distinct()


def hash_to_min(links: DataFrame, a: str, b: str, out_id: str = "id", out_group: str = "group_id", max_rounds: int = 60) -> DataFrame:
    """One row for each linked id with the least id of all that are linked to it, directly or indirectly."""
    ends = links.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null and v <> u")
    # The cluster of v holds its neighbours and v itself.
    four = F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in ("vu", "uv", "vv", "uu")])
    clusters, last = materialise(ends.select(F.inline(four)).distinct(), "clusters"), None
    for _ in range(max_rounds):
        seen = Observation()
        old = clusters
        counted = sent_clusters(old).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h"))
        clusters = materialise(counted, "clusters")
        state = seen.get
        drop_written(old)
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"no stable groups after {max_rounds} rounds")
    return clusters.groupBy(F.col("v").alias(out_id)).agg(F.min("u").alias(out_group))


def matched_pairs(pairs: DataFrame) -> DataFrame:
    """The links of ``advanced_pairs``: two different trimmed ids and at least one real shared id.

    ``exact_shared`` is split at ';'; blank pieces and placeholders image_N don't count.
    """
    pieces = F.transform(F.split("exact_shared", ";"), lambda x: F.regexp_replace(x, r"^[\s　]+|[\s　]+$", ""))
    real = F.exists(pieces, lambda x: (x != "") & ~F.lower(x).rlike(r"^image_\d+$"))
    ends = [F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "").alias(c) for c in ("a_work_answer_id", "b_work_answer_id")]
    out = pairs.where(real).select(*ends)
    return out.where("a_work_answer_id <> '' and b_work_answer_id <> ''")


def linked_groups(pairs: DataFrame) -> DataFrame:
    links = matched_pairs(pairs)
    return hash_to_min(links, "a_work_answer_id", "b_work_answer_id", "work_answer_id", "group_id")
