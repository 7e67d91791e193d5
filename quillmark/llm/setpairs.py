"""All similar pairs between set-valued records: multi-index binary sketches.

A set's sketch is a row of one-bit minhashes: bit k is one bit of the least hash of its values under hash
function k, so that two sets of Jaccard similarity J agree in a bit with probability (1 + J) / 2.  The first
``segments * segment_bits`` bits are cut into segments, one index each; the last ``CODE_BITS`` are the code
in which the Hamming distance is taken.  Sets that agree in a whole segment meet in an equi-join, stay
if their codes lie within the radius, and are then compared value by value.

Calibration: the number of segments is the least for which a pair at the threshold itself meets with
probability ``recall`` or more, and the radius the least that keeps such a pair with probability
1 - (1 - recall) / 10.  Two sets of given sizes can't have every similarity: the least one at or above the
threshold sets their radius, so that small sets just below the threshold are kept out.  Pairs above the
threshold are found more often.

A longer segment means fewer chance meetings and more segments.  Unless ``segment_bits`` is given it follows
from the counted classes: at least ``LEAST_BITS``, and as many as keep a bucket at ``PER_BUCKET`` classes or
fewer, so that the chance meetings of a set are bounded whatever the size of the table; the segments, and so
the shuffled bytes, grow by a fourth with each doubling of the classes.

Equal sets are one class: classes meet in the index, members are joined back at the end.  A class of more than
``BLOCK`` records is cut into blocks of about that many by the record's hash, and blocks meet, so that a set
shared by a third of the records fills no task: the largest one writes the pairs of two blocks.

Cases: null, blank and excluded values don't count, repeated values count once; sets below ``min_size``
give no pairs; a null record id gives none; an empty table gives none; other columns are ignored.
Values are compared by their 64-bit hashes: among the few values of a pair two different ones share a
hash with a chance below 1e-14.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import materialise

CODE_BITS = 128
SEED = 20231
LEAST_BITS, MOST_BITS = 13, 22
#: Classes of one field in a bucket, on average, beyond which segments get longer.
PER_BUCKET = 128
#: Records of one class that meet in one place.
BLOCK = 1000


def bits_for(classes: int) -> int:
    """Bits of a segment for so many classes of one field."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, classes) / PER_BUCKET))))


def segment_count(threshold: float, recall: float, segment_bits: int) -> int:
    meet = ((1 + threshold) / 2) ** segment_bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def hamming_radius(threshold: float, recall: float, bits: int = CODE_BITS) -> int:
    p, want, total = (1 - threshold) / 2, 1 - (1 - recall) / 10, 0.0
    for r in range(bits + 1):
        total += math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if total >= want:
            return r
    return bits


def one_bit_minhashes(values: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Sets x bits, 0 or 1; set i has the values from starts[i] on, none is empty."""
    factors = np.random.default_rng(SEED).integers(0, 2**63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts), bits), np.uint8)
    for k in range(0, bits, 64):
        with np.errstate(over="ignore"):
            h = values[:, None] * factors[None, k : k + 64]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum.reduceat(h, starts, axis=0)
            out[:, k : k + 64] = ((least * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)) & np.uint64(1)
    return out


def sketcher(segments: int, segment_bits: int):
    """For mapInArrow over (field_no, set_id, n, vals): the code and the key of each segment."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(segment_bits)).astype(np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column("vals")
                values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                bits = one_bit_minhashes(values, starts, segments * segment_bits + CODE_BITS)
                keys = bits[:, : segments * segment_bits].reshape(-1, segments, segment_bits).astype(np.int32) @ weights
                field = batch.column("field_no").to_numpy(zero_copy_only=False).astype(np.int32)
                keys += ((field[:, None] * segments + np.arange(segments, dtype=np.int32)) << segment_bits).astype(np.int32)
                code = np.packbits(bits[:, segments * segment_bits :], axis=1).view(np.int64)
                offsets = np.arange(0, keys.size + 1, segments, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("set_id"),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(np.ascontiguousarray(code[:, 0])),
                        pa.array(np.ascontiguousarray(code[:, 1])),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    ],
                    names=["set_id", "n", "c0", "c1", "keys"],
                )

    return sketch


def value_sets(records: DataFrame, ident: str, fields: Sequence[str], min_size: int) -> DataFrame:
    """(record, field_no, set_id, n, vals) from a table with one value a row in each field."""
    own = [F.col(f).alias(f"f{k}") for k, f in enumerate(fields)]
    rows = records.where(F.col(ident).isNotNull()).select(F.col(ident).alias("record"), *own)
    sets = [F.sort_array(F.collect_set(F.when(F.col(f"f{k}").isNotNull(), F.xxhash64(f"f{k}")))).alias(f"v{k}") for k in range(len(fields))]
    wide = rows.groupBy("record").agg(*sets)
    both = F.array(*[F.struct(F.lit(k).alias("field_no"), F.col(f"v{k}").alias("vals")) for k in range(len(fields))])
    long = wide.select("record", F.inline(both)).withColumn("n", F.size("vals")).where(F.col("n") >= min_size)
    return long.withColumn("set_id", F.xxhash64("field_no", "vals"))


def similar_pairs(
    records: DataFrame,
    ident: str,
    fields: Sequence[str],
    threshold: float = 0.6,
    min_size: int = 3,
    recall: float = 0.99,
    segment_bits: int | None = None,
) -> DataFrame:
    """(field_name, a_<ident>, b_<ident>, similarity) with a < b, for each of ``fields`` by itself.

    ``records`` has one row for each value; prepare the values (case, blanks, placeholders to null) first.
    """
    # The radius for the least similarity from the threshold up that sets of these sizes can have, in steps of 0.01.
    radii = F.array(*[F.lit(hamming_radius(max(threshold, k / 100), recall)) for k in range(101)])
    sizes = F.col("a.n") + F.col("b.n")
    needed = F.ceil(threshold / (1 + threshold) * sizes - 1e-9)
    radius = F.get(radii, F.floor(100 * needed / (sizes - needed) + 1e-9).cast("int"))
    members = materialise(value_sets(records, ident, fields, min_size), "sets")
    per_class = members.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("field_no", "n", "vals")], F.count(F.lit(1)).alias("records"))
    classes = materialise(per_class.withColumn("blocks", F.ceil(F.col("records") / BLOCK).cast("int")), "classes")
    if segment_bits is None:
        largest = classes.groupBy("field_no").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        segment_bits = bits_for(largest or 0)
    segments = segment_count(threshold, recall, segment_bits)
    if len(fields) * segments << segment_bits > 2**31:
        raise ValueError("too many fields or too long segments for 32-bit keys")

    sketch = sketcher(segments, segment_bits)
    schema = "set_id long, n int, c0 long, c1 long, keys array<int>"
    index = classes.select("field_no", "set_id", "n", "vals").mapInArrow(sketch, schema)
    index = index.select("set_id", "n", "c0", "c1", F.explode("keys").alias("key"))
    a, b = index.alias("a"), index.alias("b")
    near = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.set_id") < F.col("b.set_id"))
        & (F.bit_count(F.col("a.c0").bitwiseXOR(F.col("b.c0"))) + F.bit_count(F.col("a.c1").bitwiseXOR(F.col("b.c1"))) <= radius)
        & (F.col("a.n") >= threshold * F.col("b.n") - 1e-9)
        & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    )
    candidates = a.join(b.hint("merge"), near).select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct()

    left = classes.select(F.col("set_id").alias("a"), "field_no", F.col("n").alias("na"), F.col("vals").alias("va"), F.col("blocks").alias("pa"))
    right = classes.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("vals").alias("vb"), F.col("blocks").alias("pb"))
    shared = F.size(F.array_intersect("va", "vb"))
    compared = candidates.join(left, "a").join(right, "b").withColumn("shared", shared)
    compared = compared.withColumn("similarity", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    alike = compared.where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "field_no", "similarity", "pa", "pb")
    # A class is like itself once it has two records; its blocks meet in one order only.
    itself = classes.where("records > 1")
    itself = itself.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), "field_no", F.lit(1.0).alias("similarity"), F.col("blocks").alias("pa"), F.col("blocks").alias("pb"))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    meet = alike.union(itself).withColumn("ka", every("pa")).withColumn("kb", every("pb")).where("a <> b or ka <= kb")
    who = members.join(classes.select("set_id", "blocks"), "set_id").select("set_id", F.pmod(F.xxhash64("record"), "blocks").cast("int").alias("k"), "record")
    pairs = meet.join(who.toDF("a", "ka", "ra"), ["a", "ka"]).join(who.toDF("b", "kb", "rb"), ["b", "kb"]).where("a <> b or ka < kb or ra < rb")
    names = F.array(*[F.lit(f) for f in fields])
    return pairs.select(
        F.get(names, F.col("field_no")).alias("field_name"),
        F.least("ra", "rb").alias(f"a_{ident}"),
        F.greatest("ra", "rb").alias(f"b_{ident}"),
        "similarity",
    )


def asset_values(assets: DataFrame) -> DataFrame:
    """work_answer_id, object_id and sha256 of the downloaded assets: trimmed, in lower case, null for no value."""

    def real(name: str):
        bare = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
        return F.when((bare != "") & ~bare.rlike(r"^image_\d+$"), bare).alias(name)

    return assets.where("ok").select("work_answer_id", real("object_id"), real("sha256"))


def submission_pairs(assets: DataFrame) -> DataFrame:
    pairs = similar_pairs(asset_values(assets), "work_answer_id", ["object_id", "sha256"])
    return pairs.select("field_name", "a_work_answer_id", "b_work_answer_id")
