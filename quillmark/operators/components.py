"""Connected components by contraction.

Each round a vertex merges into the least of itself and its neighbours, then into that one's choice, and the
edges are drawn anew between what is left, so that a component at least halves; the label of a component is its
least id.  A round writes the jumps of the vertices that still have edges and the edges between what is left,
counted while they are written; both shrink from round to round.  The labels are the jumps of all rounds in a
row, composed once at the end from the last and smallest backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillmark.session import drop_written, materialise


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """(id, component) for every id with an edge to another one; nulls and loops are no edges."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = materialise(e.union(e.select("y", "x")).distinct(), "edges")
    jumps: list[DataFrame] = []
    for _ in range(most_rounds):
        least = e.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        least = materialise(least, "least")
        jump = materialise(least.join(least.toDF("z", "to"), F.col("m") == F.col("z")).select("x", "to"), "jumps")
        jumps.append(jump)
        drawn = e.join(jump.toDF("x", "p"), "x").join(jump.toDF("y", "q"), "y").where("p <> q")
        left = Observation()
        fewer = materialise(drawn.select(F.col("p").alias("x"), F.col("q").alias("y")).distinct().observe(left, F.count(F.lit(1)).alias("n")), "edges")
        drop_written(e, least)
        e = fewer
        if not left.get.get("n"):
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    label = jumps[-1].toDF("id", "component")
    for jump in reversed(jumps[:-1]):
        # What a vertex jumped to may have jumped on.
        later = label.toDF("to", "on")
        label = jump.join(later, "to", "left").select(F.col("x").alias("id"), F.coalesce("on", "to").alias("component"))
    return label
