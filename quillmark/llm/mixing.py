"""Sources combined at target weights: a multivariate-hypergeometric splitting tree.

The total is the largest at which every source meets its share without any document being used more than the
source's ``max_repeats`` times (or the total asked for, if less).  A source's quota is whole rounds over all its
documents and a part of one more, cut in a random order of the documents at exact running token counts.  The
tokens of all rounds, in that order, are cut into blocks.  The tree deals the blocks to output shards: a node
draws from its exact counts of blocks by source the part that goes left (multivariate hypergeometric, so every
dealing is equally likely and none is used twice) until single shards remain.  A shard's blocks of a source are
a stretch of a random permutation of that source's blocks; within a shard the records are shuffled by a hash.

Only the counts of blocks by source reach the driver: sources x shards numbers, shards bounded by ``MOST_SHARDS``.

Sizes follow from the total unless they are given.  A block has ``LEAST_BLOCK`` tokens, or more where there would
be over ``MOST_BLOCKS`` blocks; a shard has about ``SHARD_TOKENS`` tokens, or more where there would be over
``MOST_SHARDS`` shards.  A shard larger than that is written by several tasks, each with a range of the shuffling
hash, so that a task holds some ``SHARD_TOKENS`` tokens (about 64 MB of text) whatever the size of the mix.

Cases: documents of no source, of a source without a target or a weight of 0, with a null or empty text are
left out; a source without documents can't have a share, the others keep their weights towards each other;
empty tables give no records; repeated document ids are documents of their own; ``max_repeats`` below 1 is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.positions import running_totals
from quillmark.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts a text before byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_SHARDS = 4096
LEAST_SHARDS = 16
SHARD_TOKENS = 16_000_000
LEAST_BLOCK = 1024
MOST_BLOCKS = 10**9

_LOADED: dict = {}


def encoder(path: str, pattern: str = PATTERN):
    """The tokenizer of a file of ranks; kept for the next batch of the same worker."""
    import base64

    import tiktoken

    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counter(path: str):
    """For mapInArrow: adds n_tokens, counted over the column text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [len(own.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return count


def source_key(name: str):
    key = F.lower(F.regexp_replace(name, r"^[\s　]+|[\s　]+$", ""))
    return F.when(key != "", key)


def drawn_of(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric number for counts beyond numpy's: the point of the distribution function that a uniform
    number meets, over all values within forty deviations of the mode; what lies beyond weighs under 1e-300."""
    total = good + bad
    lowest, highest = max(0, draws - bad), min(good, draws)
    mode = (draws + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(max(1.0, draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))))
    low, high = max(lowest, int(mode - 40 * spread) - 40), min(highest, int(mode + 40 * spread) + 40)
    k = np.arange(low, high, dtype=np.float64)  # the weight of k + 1 against that of k
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1]))


def drawn(rng: np.random.Generator, have: np.ndarray, draws: int) -> np.ndarray:
    """How many of ``draws`` blocks drawn without replacement are of each source."""
    if have.sum() < 10**9:
        return rng.multivariate_hypergeometric(have, draws, method="marginals")
    out, rest = np.zeros_like(have), int(have.sum())
    for i, n in enumerate(map(int, have)):
        rest -= n
        out[i] = drawn_of(rng, n, rest, draws) if n and rest and draws else min(n, draws)
        draws -= int(out[i])
    return out


def split_tree(counts: dict[str, int], shards: int, seed: int) -> list[dict[str, int]]:
    """Blocks of each source for each shard: exact, disjoint, random."""
    names, rng = sorted(counts), np.random.default_rng(seed)
    out: list[dict[str, int]] = []

    def deal(have: np.ndarray, k: int) -> None:
        if k == 1:
            out.append(dict(zip(names, map(int, have), strict=True)))
            return
        left = k // 2
        part = drawn(rng, have, int(have.sum()) * left // k) if have.sum() else have
        deal(part, left)
        deal(have - part, k - left)

    deal(np.array([counts[n] for n in names], np.int64), shards)
    return out


def mixed(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str = "weight_percent",
    repeats: str = "max_repeats",
    total_tokens: int | None = None,
    shards: int | None = None,
    block_tokens: int | None = None,
    tokenizer: str = TOKENIZER,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, copy_no, shard, n_tokens, text): a row for each use of a document."""
    if shards is not None and not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must lie between 1 and {MOST_SHARDS}")
    spark = docs.sparkSession
    goal = targets.select(source_key(source).alias("s"), F.col(weight).cast("double").alias("w"), F.greatest(F.coalesce(F.col(repeats), F.lit(1)), F.lit(1)).cast("long").alias("r"))
    goal = goal.where("s is not null and w > 0").groupBy("s").agg(F.max("w").alias("w"), F.max("r").alias("r"))
    rows = docs.select(F.col(doc_id).alias("doc"), source_key(source).alias("s"), F.col(text).alias("text")).where("text <> ''")
    rows = rows.join(goal.select("s"), "s", "left_semi")
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    counted = rows.mapInArrow(token_counter(tokenizer), f"{fields}, n_tokens long")
    counted = materialise(counted.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    sized = counted.select("uid", "s", "n_tokens").where("n_tokens > 0")

    sums = {r["s"]: (r["t"], r["w"], r["r"]) for r in sized.groupBy("s").agg(F.sum("n_tokens").alias("t")).join(goal, "s").collect()}  # a row for each target
    all_weight = sum(w for _, w, _ in sums.values())
    most = min((t * r * all_weight / w for t, w, r in sums.values()), default=0.0)
    total = min(most, total_tokens) if total_tokens else most
    if block_tokens is None:
        block_tokens = max(LEAST_BLOCK, math.ceil(total / MOST_BLOCKS))
    if shards is None:
        shards = min(MOST_SHARDS, max(LEAST_SHARDS, math.ceil(total / SHARD_TOKENS)))
    plan = []
    for s, (t, w, r) in sorted(sums.items()):
        quota = min(int(total * w / all_weight), t * r)
        rounds, part = divmod(quota, t)
        plan.append((s, t, rounds, part, -(-quota // block_tokens)))
    table = spark.createDataFrame(plan, "s string, t long, rounds long, part long, blocks long")

    placed = running_totals(sized, ["s"], [F.xxhash64(F.lit(seed), "uid"), "uid"], F.col("n_tokens"), out="upto", total=None)
    placed = placed.join(F.broadcast(table), "s")  # a row for each target
    uses = F.col("rounds") + F.when(F.col("upto") - F.col("n_tokens") / 2 <= F.col("part"), 1).otherwise(0)
    used = placed.withColumn("uses", uses).where("uses > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    start = F.col("copy_no") * F.col("t") + F.col("upto") - F.col("n_tokens")
    used = used.withColumn("block", F.least(F.floor(start / block_tokens), F.col("blocks") - 1))

    dealt = split_tree({s: b for s, _, _, _, b in plan}, shards, seed) if plan else []
    at, stretches, rng = {s: 0 for s, *_ in plan}, [], np.random.default_rng(seed + 1)
    for k, have in enumerate(dealt):
        for s, n in have.items():
            if n:
                stretches.append((s, k, at[s], at[s] + n - 1))
            at[s] += n
    mixers = []  # rank = (a * block + c) mod blocks: a permutation of the source's blocks
    for s, _, _, _, b in plan:
        a = next(x for x in iter(lambda: int(rng.integers(1, max(2, b))), None) if math.gcd(x, b) == 1) if b > 1 else 1
        mixers.append((s, a, int(rng.integers(0, max(1, b)))))
    ranks = spark.createDataFrame(stretches, "s string, shard int, lo long, hi long").select("s", "shard", F.explode(F.sequence("lo", "hi")).alias("rank"))
    used = used.join(F.broadcast(spark.createDataFrame(mixers, "s string, a long, c long")), "s")
    used = used.withColumn("rank", F.pmod(F.col("a") * F.col("block") + F.col("c"), F.col("blocks")))
    used = used.join(ranks, ["s", "rank"]).select("uid", "copy_no", "shard")

    out = used.join(counted, "uid")
    out = out.select(F.col("doc").alias(doc_id), F.col("s").alias(source), F.col("copy_no").cast("int").alias("copy_no"), "shard", "n_tokens", F.col("text").alias(text), F.xxhash64(F.lit(seed), "uid", "copy_no").alias("__o"))
    # A shard's records by rising hash, in ``parts`` even ranges of it.
    parts = max(1, math.ceil(total / shards / SHARD_TOKENS))
    span = F.floor((F.shiftrightunsigned("__o", 1).bitwiseXOR(F.lit(1 << 62))) / F.lit(2.0**63) * parts)
    out = out.withColumn("__part", F.least(span.cast("int"), F.lit(parts - 1)))
    return out.repartition(shards * parts, "shard", "__part").sortWithinPartitions("shard", "__part", "__o").drop("__o", "__part")


def shares(mix: DataFrame, targets: DataFrame, source: str = "source", weight: str = "weight_percent", repeats: str = "max_repeats") -> DataFrame:
    """A row for each target: its weight, its tokens and records in the mix, its actual share in percent, and the most uses of a document."""
    got = mix.groupBy(F.col(source).alias("s")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), (F.max("copy_no") + 1).alias("most_uses"))
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    goal = targets.select(source_key(source).alias("s"), weight, repeats).where("s is not null")
    out = goal.join(got, "s", "left").crossJoin(all_tokens)  # one row
    zero = F.lit(0)
    return out.select(
        F.col("s").alias(source),
        weight,
        repeats,
        F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("records", zero).alias("records"),
        F.coalesce("most_uses", zero).alias("most_uses"),
        F.coalesce(100 * F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_percent"),
    )
