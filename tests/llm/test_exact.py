"""Set pairs, groups, cut-offs, leaks and mixing against brute force on small tables."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.llm import cutoffs, groups, leaks, mixing, setpairs

EMPTY = "select * from values (1) where false"


# -- similar pairs of sets ---------------------------------------------------------------------------------


def brute_pairs(sets, threshold=0.6, least=3):
    ids = sorted(i for i in sets if i is not None and len(sets[i]) >= least)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize("block", [1000, 7])
def test_set_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(setpairs, "BLOCK", block)  # the thirty equal sets in blocks too
    rnd = random.Random(1)
    sets, data = {}, []
    for g in range(60):
        base = [f"{g}-{k}" for k in range(rnd.randrange(3, 14))]
        for m in range(rnd.randrange(1, 5)):
            s = {v for v in base if rnd.random() > 0.15} | {f"{g}-{m}-x"} | ({"template"} if rnd.random() < 0.7 else set())
            sets[f"r{g:02}{m}"] = s
    for i in range(30):  # a set shared by a third of the records
        sets[f"z{i:02}"] = {"template", "p", "q", "s"}
    for i, s in sets.items():
        data += [(i, v, v, 1) for v in s for _ in range(rnd.randrange(1, 3))]
    data += [("r000", None, "a", 1), (None, "p", None, 1), (None, "q", None, 1), (None, "s", None, 1)]
    df = spark.createDataFrame(data, "record string, tags string, n string, field_no int")
    got = setpairs.similar_pairs(df, "record", ["tags"], recall=0.999).collect()
    want = brute_pairs(sets)
    pairs = Counter((r["a_record"], r["b_record"]) for r in got)
    assert max(pairs.values()) == 1 and set(pairs) <= want and len(set(pairs)) >= 0.99 * len(want) and len(want) > 450
    both = setpairs.similar_pairs(df, "record", ["tags", "n"], recall=0.999)
    assert {r["field_name"] for r in both.collect()} == {"tags", "n"}
    assert setpairs.similar_pairs(df.limit(0), "record", ["tags"]).count() == 0


def test_calibration():
    assert setpairs.segment_count(0.6, 0.97, 13) == 63
    assert setpairs.hamming_radius(1.0, 0.97) == 0
    # Thirteen bits up to a million and more classes, then a bit for each doubling: the bucket stays as full.
    assert [setpairs.bits_for(n) for n in (0, 36_000, 1_048_576, 1_100_000, 40_000_000)] == [13, 13, 13, 14, 19]
    for n in (10**6, 10**7, 10**8):
        assert n / 2 ** setpairs.bits_for(n) <= setpairs.PER_BUCKET
    radii = [setpairs.hamming_radius(t / 10, 0.97) for t in range(3, 11)]
    assert radii == sorted(radii, reverse=True)


def test_asset_values(spark):
    df = spark.createDataFrame([("a", True, " AB \t", "image_1"), ("a", False, "x", "y"), ("a", None, "x", "y"), ("a", True, "Image_12", "")], "work_answer_id string, ok boolean, object_id string, sha256 string")
    assert [tuple(r) for r in setpairs.asset_values(df).collect()] == [("a", "ab", None), ("a", None, None)]


# -- groups ------------------------------------------------------------------------------------------------


def brute_groups(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed, monkeypatch):
    monkeypatch.setattr(groups, "HOT", 20)  # the salted way too
    rnd = random.Random(seed)
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]  # a chain
    links += [("hub", f"s{i:03}") for i in range(80)]  # a star
    links += [(f"x{rnd.randrange(60):02}", f"x{rnd.randrange(60):02}") for _ in range(40)]
    links += [(b, a) for a, b in links[:30]] + links[:10] + [("lone", "lone"), (None, "n"), ("n", None)]
    df = spark.createDataFrame([(a, b, "v") for a, b in links], "v string, b string, u string")
    got = groups.hash_to_min(df, "v", "b").collect()
    assert {r["id"]: r["group_id"] for r in got} == brute_groups(links) and len(got) == len(brute_groups(links))
    assert groups.hash_to_min(df.limit(0), "v", "b").count() == 0


def test_a_round_of_a_hot_vertex(spark):
    """A vertex over the bound: its rows aren't shuffled by the vertex, three exchanges and a broadcast do."""
    rows = spark.range(3000).selectExpr("0L as v", "id as u").union(spark.range(1, 3000).selectExpr("id as v", "0L as u"))
    rows = groups.materialise(rows, "t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = groups.sent_clusters(rows, hot=100)
        assert out.count() == 3000 + 2999  # (0, u) for all u, (u, 0) for the others
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the least members (three readings of one exchange), the rows of small clusters, the distinct
        assert plan.count("BroadcastHashJoin") >= 2 and plan.count("Exchange hashpartitioning") <= 5, plan
        groups.drop_written(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_matched_pairs(spark):
    rows = [(" a", "b\t", "x", 1), ("b", "c", "image_3; ;", 1), ("c", "d", None, 1), ("d", "e", "; image_1;y", 1), ("f", "f", "x", 1), ("", "g", "x", 1), (None, "g", "x", 1)]
    df = spark.createDataFrame(rows, "a_work_answer_id string, b_work_answer_id string, exact_shared string, v int")
    assert {(r["work_answer_id"], r["group_id"]) for r in groups.linked_groups(df).collect()} == {("a", "a"), ("b", "a"), ("d", "d"), ("e", "d")}


# -- cut-offs ----------------------------------------------------------------------------------------------


def test_cutoffs(spark):
    rnd = random.Random(2)
    data = [("hot" if i % 3 else f"s{i % 5}", rnd.randrange(40), i) for i in range(400)] + [("tie", 7, i) for i in range(10)] + [("hot", None, 999), (None, 1, 1000), ("untargeted", 1, 1001)]
    targets = {"hot": 33, "s0": 1, "s1": 100, "s2": 50, "s3": 90, "s4": 67, "tie": 20, "none": 50}
    df = spark.createDataFrame([(*r, "k", "n") for r in data], "src string, x int, i int, k string, n string")
    goal = spark.createDataFrame(list(targets.items()), "src string, p int")
    got = {r["src"]: (r["cutoff"], r["kept_rows"]) for r in cutoffs.fraction_cutoffs(df, goal, "src", "x", "i", "p").collect()}
    want = {}
    for s, p in targets.items():
        xs = sorted(x for g, x, _ in data if g == s and x is not None)
        if xs:
            c = xs[-(-p * len(xs) // 100) - 1]
            want[s] = (c, sum(x <= c for x in xs))
    assert got == want and "none" not in got
    assert cutoffs.fraction_cutoffs(df.limit(0), goal, "src", "x", "i", "p").count() == 0


def test_submission_cutoffs(spark):
    rows = [(1, "a", " X1 ", "2024-02-01 10:00"), (2, "a", "x1", "2024-02-03 10:00"), (3, "b", "X1", "2024-02-02 10:00"), (4, "c", "x1", "刚刚"), (5, "d", None, "2024-02-02 10:00"), (6, "e", " ", "2024-02-02 11:00")]
    df = spark.createDataFrame(rows, "submit_row long, work_answer_id string, class_name string, submit_time string").withColumns({"campus_tz": F.lit("UTC"), "collected_at": F.lit("2024-03-01").cast("timestamp"), "k": F.lit(1)})
    goal = spark.createDataFrame([("X1", 50), ("未分班", 100), ("empty", 10)], "class_name string, keep_percent int")
    got = {r["class_name"]: (r["cutoff_ms"], r["kept_rows"]) for r in cutoffs.submission_cutoffs(df, goal).collect()}
    assert got == {"X1": (1706868000000, 1), "未分班": (1706871600000, 2)}


# -- leaks -------------------------------------------------------------------------------------------------

EN = "The Vandeck protocol sends 429 octets every 17 ticks. Records from a lamp museum list 4 faults but Quorowyn admits 562."
ZH = "审计组用769条样本推断日志轮转后丢掉首行，从方志馆借来的汐鸢密钥早已过期33周，题设中冷链记录仪每29秒上报。"


def wide(text):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


def test_leaks(spark):
    words = EN.split()
    zh = "".join(c for c in ZH if c.isalnum())
    texts = {
        1: "before " + EN + " after",
        2: "x " + " ".join(words[2:14]) + " y",  # twelve words
        3: "x " + " ".join(words[2:13]) + " y",  # eleven
        4: wide(EN.upper()),
        5: "> " + EN.replace(" ", "\n// "),
        6: "ab​c " + "​".join(EN),
        7: "文" + zh[5:29] + "章",  # twenty-four characters
        8: "文" + zh[5:28] + "章",
        9: " ".join(zh),
        10: "",
        11: None,
        12: "lorem " * 50_000 + EN,
        13: "un" + " ".join(words[2:14]) + " y",  # begins inside a word
        14: EN + " " + ZH,
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, item string")
    items = spark.createDataFrame([(1, "en", EN), (2, "zh", ZH), (3, "zh", ZH), (4, "en", "too short"), (5, None, None)], "item_id long, lang string, passage string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaking_documents(docs, items).collect()}
    want = {(d, 1) for d in (1, 2, 4, 5, 6, 12, 14)} | {(d, i) for d in (7, 9, 14) for i in (2, 3)}
    assert got == want
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in leaks.leaked_passages(docs, items).where("item_id = 1").collect()}
    assert texts[1][slice(*spans[1])] == EN[:-1]
    assert texts[12][slice(*spans[12])] == EN[:-1]
    blocks = leaks.leaked_passages(docs, items, max_items=2).select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in blocks.collect()} == want
    assert leaks.leaking_documents(docs, items.limit(0)).count() == 0
    assert leaks.leaking_documents(docs.limit(0), items).count() == 0


# -- mixing ------------------------------------------------------------------------------------------------

needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer files")


@needs_tokenizer
def test_mixing(spark):
    rnd = random.Random(5)
    docs = [(i, "alpha beta gamma delta " * rnd.randrange(3, 30), rnd.choice(["Big ", "big", "mid", " SMALL"] + ["big"] * 4)) for i in range(500)]
    docs += [(900, None, "big"), (901, "", "mid"), (902, "text", None), (903, "text", "other"), (1, "repeated id", "mid")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, source string, s string")
    goal = spark.createDataFrame([("big", 40, 1), ("mid", 30, 3), ("small", 30, 5), ("absent", 0, 2)], "source string, weight_percent int, max_repeats int")
    mix = mixing.mixed(df, goal, shards=5, block_tokens=64)
    rows = [r.asDict() for r in mix.collect()]
    uses = Counter((r["doc_id"], r["text"]) for r in rows)
    limit = {"big": 1, "mid": 3, "small": 5}
    for r in rows:
        assert uses[r["doc_id"], r["text"]] <= limit[r["source"]]
    assert len({(r["doc_id"], r["text"], r["copy_no"]) for r in rows}) == len(rows)
    share = {r["source"]: r for r in mixing.shares(mix, goal).collect()}
    for s, w in (("big", 40), ("mid", 30), ("small", 30)):
        assert abs(share[s]["actual_percent"] - w) < 1.0 and share[s]["most_uses"] <= limit[s]
    assert share["absent"]["tokens"] == 0
    assert {r["shard"] for r in rows} == set(range(5))
    # the same again, and a smaller total
    key = lambda rs: sorted((r["doc_id"], r["copy_no"], r["shard"]) for r in rs)
    assert key(rows) == key(r.asDict() for r in mixing.mixed(df, goal, shards=5, block_tokens=64).collect())
    small = mixing.mixed(df, goal, total_tokens=2000, shards=2, block_tokens=64).agg(F.sum("n_tokens")).first()[0]
    assert 1800 < small < 2200
    assert mixing.mixed(df.limit(0), goal).count() == 0


@needs_tokenizer
def test_token_count_is_the_tokenizers():
    own = mixing.encoder(mixing.TOKENIZER)
    for text in ("plain words", "注解基本到位", "a\n\n b  c", ""):
        assert own.decode(own.encode_ordinary(text)) == text


def test_split_tree_is_exact():
    counts = {"a": 1000, "b": 7, "c": 0, "d": 350}
    dealt = mixing.split_tree(counts, 13, 3)
    assert len(dealt) == 13 and {n: sum(d[n] for d in dealt) for n in counts} == counts
    sizes = [sum(d.values()) for d in dealt]
    assert max(sizes) - min(sizes) <= 4


def test_split_tree_beyond_a_billion_blocks():
    counts = {"a": 5 * 10**10, "b": 10**9, "c": 7, "d": 3 * 10**9}
    dealt = mixing.split_tree(counts, 8, 3)
    assert {n: sum(d[n] for d in dealt) for n in counts} == counts
    assert max(sum(d.values()) for d in dealt) - min(sum(d.values()) for d in dealt) <= 3
    assert all(abs(d["a"] / sum(d.values()) - 5 / 5.4) < 1e-4 for d in dealt)


def test_large_draws_are_hypergeometric():
    import numpy as np

    rng = np.random.default_rng(4)
    for good, bad, draws in ((30, 70, 40), (3, 5, 8), (1000, 10, 500), (5, 5, 0)):
        own = [mixing.drawn_of(rng, good, bad, draws) for _ in range(3000)]
        mean = draws * good / (good + bad)
        spread = (mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1)) ** 0.5
        assert abs(np.mean(own) - mean) <= 5 * spread / 3000**0.5 + 1e-9 and abs(np.std(own) - spread) <= 0.1 * spread + 1e-9


@needs_tokenizer
def test_large_shards_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 100)
    docs = spark.createDataFrame([(i, "alpha beta gamma", "a") for i in range(400)], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 100, 1)], "source string, weight_percent int, max_repeats int")
    mix = mixing.mixed(docs, goal, shards=2, block_tokens=16).select("doc_id", "shard", F.spark_partition_id().alias("task"))
    rows = mix.collect()
    assert len(rows) == 400 and len({(r["shard"], r["task"]) for r in rows}) > 4
