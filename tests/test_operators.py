"""Row, common-value, similarity and scalar operators against brute force on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillmark.functions import extract, scalars
from quillmark.operators import assets, rows
from quillmark.operators.common import common_values, shared_value_pairs, without_common
from quillmark.operators.components import components
from quillmark.operators.positions import running_totals
from quillmark.operators.similarity import average_hash, best_match_mean, code_pairs, containment_pairs, pairs_of_equals, ratio_matches, text_pairs


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, " Ａ，b。　C ", scalars.bare_text(x)) == "ａbc"
    assert one(spark, None, scalars.bare_text(x)) == ""
    assert one(spark, "a\\b｜c  “D”：", scalars.ocr_text(x)) == 'a/b/c "d":'
    assert one(spark, ' a/b:c  d"', scalars.slug(x)) == "a_b_c_d_"
    assert one(spark, "", scalars.slug(x)) == "item"
    assert one(spark, "<p>a&amp;lt;b</p><script>x</script><br/>c&nbsp;d", scalars.html_text(x)) == "a&lt;b\n \nc d"  # a script leaves a blank
    assert one(spark, "a<b>b</b>c<pre>d</pre>e", scalars.html_text(x)) == "a b c d\ne"
    assert one(spark, '<a b="c">\'&', scalars.html_escape(x)) == "&lt;a b=&quot;c&quot;&gt;&#39;&amp;"
    assert one(spark, "=1+1", scalars.csv_guard(x)) == "'=1+1"
    assert one(spark, "-5", scalars.csv_guard(x)) == "'-5"
    assert one(spark, None, scalars.csv_guard(x)) == ""
    assert one(spark, "aab", scalars.ngrams(x)) == ["aab"]
    assert one(spark, "ab", scalars.ngrams(x)) == []
    assert one(spark, "x [A] mid [Z] end [B]", scalars.between(x, ["[A]", "[C]"], ["[B]", "[Z]"])) == "mid"
    assert one(spark, "no marker", scalars.between(x, ["[A]"], ["[B]"])) is None
    assert one(spark, "", scalars.number(x)) == 0.0 and one(spark, "缺", scalars.number(x)) == 0.0
    assert one(spark, " 88.5分", scalars.leading_number(x)) == 88.5
    assert one(spark, "-2.5", scalars.half_up(x.cast("double"))) == -2.0
    assert one(spark, "140", scalars.clamp(x.cast("double"), 100)) == 100.0
    for text, n in (("十", 10), ("十二", 12), ("二十", 20), ("三十五", 35), ("七", 7), ("", 999), ("甲", 999)):
        assert one(spark, text, scalars.chinese_number(x)) == n
    assert one(spark, 'I say ```json\n{"a": 1}\n``` ok', scalars.json_object(x)) == '{"a":1}'
    assert one(spark, "no {json", scalars.json_object(x)) is None
    assert one(spark, "0" * 62 + "11", scalars.bits(x)) == 3
    assert one(spark, "1" * 64, scalars.bits(x)) == -1
    assert one(spark, "1" * 63, scalars.bits(x)) is None


def test_extraction(spark):
    x = F.col("x")
    text = "靶场10.0.0.5中 nc  -lvp 4444\nListening on 0.0.0.0 9 见 http://a.b/c, app.war"
    assert set(one(spark, text, extract.evidence_tokens(x))) == {"10.0.0.5", "nc -lvp 4444", "listening on 0.0.0.0 9", "0.0.0.0", "http://a.b/c,", "app.war"}
    assert one(spark, None, extract.evidence_tokens(x)) == []
    assert one(spark, "学号2021031677与12345678901", extract.long_numbers(x)) == ["2021031677"]
    assert one(spark, "x " + "aGVsbG8gd29ybGQgaGVsbG8gd29ybGQ=" + " y", extract.base64_pieces(x)) == ["hello world hello world"]


def test_last_first_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z"), ("b", 1, "z")], "k string, n int, v string")
    assert {tuple(r) for r in rows.last_by(df, ["k"], ["n"]).collect()} == {("a", 2, None), ("b", 1, "z")}
    assert {tuple(r) for r in rows.first_by(df, ["k"], ["n"]).collect()} == {("a", 1, "x"), ("b", 1, "z")}
    new = spark.createDataFrame([("a", 9, "n")], df.schema)
    assert {r["n"] for r in rows.upsert(df, new, ["k"]).collect()} == {9, 1}
    assert rows.last_by(df.limit(0), ["k"], ["n"]).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 1.0), ("b", 2.0)], "k string, v double")
    assert sorted(r["rank"] for r in rows.competition_rank(df, ["k"], F.col("v")).where("k = 'a'").collect()) == [1, 1, 3]
    assert sorted(r["share"] for r in rows.position_share(df, ["k"], ["v"]).collect()) == [1 / 3, 2 / 3, 1.0, 1.0]


def test_ranks_of_hot_groups(spark):
    rnd = random.Random(8)
    data = [("hot" if i % 3 else f"g{i % 5}", rnd.choice([None, *range(12)]), i) for i in range(500)] + [(None, 3, 900), (None, 4, 901)]
    df = spark.createDataFrame(data, "g string, x int, __n int")
    got = {r["__n"]: r["rank"] for r in rows.competition_rank(df, ["g"], F.col("x")).collect()}
    low = -1
    assert got == {i: 1 + sum((y if y is not None else low) > (x if x is not None else low) for h, y, _ in data if h == g) for g, x, i in data}


def test_nearest_two(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [2.0, 0.0], 2), (3, [0.1, 0.0], 1), (100, [5.0, 0.0], 3), (200, [9.0, 9.0], None)], "id int, v array<double>, image int")
    got = [tuple(r) for r in ratio_matches(points, "id", "v", "image").collect()]
    assert got == [(0, 1, 1.0, 0.5)]


def test_running_totals_of_a_hot_group(spark):
    rnd = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 7}", rnd.randrange(50), i, rnd.randrange(9)) for i in range(600)] + [(None, 1, 1000, 2)]
    df = spark.createDataFrame(data, "g string, x int, i int, w int")
    got = {r["i"]: (r["position"], r["group_total"]) for r in running_totals(df, ["g"], ["x", "i"], F.col("w"), partitions=5).collect()}
    for group in {r[0] for r in data}:
        own, total = sorted((r for r in data if r[0] == group), key=lambda r: (r[1], r[2])), 0
        for r in own:
            total += r[3]
            assert got[r[2]] == (total, sum(x[3] for x in own))
    assert len(got) == len(data)


def test_common_and_shared(spark):
    data = [(r, "c") for r in range(10)] + [(0, "x"), (1, "x"), (1, "x"), (2, None), (3, "y"), (4, "y"), (3, "z"), (4, "z")]
    df = spark.createDataFrame(data, "r int, v string")
    assert [tuple(r) for r in common_values(df, "r", "v").collect()] == [("c", 10)]
    pairs = shared_value_pairs(without_common(df, "r", "v"), "r", "v").collect()
    assert {tuple(p) for p in pairs} == {(0, 1, 1), (3, 4, 2)}


def test_text_pairs_lose_none(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefg") for _ in range(60)) for _ in range(12)]
    texts = []
    for i in range(80):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(6)):
            t[rnd.randrange(60)] = rnd.choice("abcdefg")
        texts.append((i, i % 2, "".join(t)))
    texts += [(900, 0, texts[0][2]), (901, 0, "short"), (902, 0, None)]
    got = {(r["a"], r["b"]): r["text_similarity"] for r in text_pairs(spark.createDataFrame(texts, "id int, g int, t string"), "id", "t", ["g"], 0.6).collect()}
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, _, t in texts if t and len(t) >= 20}
    group = {i: g for i, g, _ in texts}
    want = {}
    for a in grams:
        for b in grams:
            if a < b and group[a] == group[b]:
                j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
                if int(j * 10000 + 0.5) / 10000 >= 0.6:
                    want[a, b] = int(j * 10000 + 0.5) / 10000
    assert got == want and len(want) > 20


def test_code_pairs_and_likeness(spark):
    rnd = random.Random(4)
    codes = [rnd.getrandbits(64) for _ in range(60)]
    codes += [c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for c in codes[:30]]
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed] + [(None,)], "c long")
    got = {(r["a"], r["b"]): r["distance"] for r in code_pairs(df, "c", 5).collect()}
    want = {(a, b): ((a ^ b) & (2**64 - 1)).bit_count() for a in set(signed) for b in set(signed) if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 5}
    assert got == want and len(want) >= 25
    h = spark.createDataFrame([("p", 0), ("p", 3), ("q", 1)], "r string, c long")
    r = best_match_mean(spark.createDataFrame([("p", "q")], "a string, b string"), h, "a", "b", "r", "c").first()
    assert (r["mean_best"], r["best"]) == (int((1 - 1 / 64) * 10000 + 0.5) / 10000,) * 2


def test_containment_and_average_hash(spark):
    df = spark.createDataFrame([(1, t) for t in "abc"] + [(2, t) for t in "abcdef"] + [(3, t) for t in "ax"] + [(4, None)], "r int, t string")
    assert [tuple(r) for r in containment_pairs(df, "r", "t", 0.6).collect()] == [(1, 2, 3, 1.0)]
    v = spark.createDataFrame([([float(i) for i in range(64)],), ([1.0],)], "v array<float>").select(average_hash(F.col("v")).alias("h")).collect()
    assert [r["h"] for r in v] == ["0" * 32 + "1" * 32, None]


def test_pairs_of_equals(spark):
    data = [("hot", i) for i in range(40)] + [("two", 50), ("two", 51), ("one", 60)]
    want = {(a, b) for a in range(40) for b in range(a + 1, 40)} | {(50, 51)}
    for block in (1000, 7, 1):
        got = [tuple(r) for r in pairs_of_equals(spark.createDataFrame(data, "c string, i int"), "c", "i", block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_origin_url(spark):
    x, i = F.col("x"), "5e48e3a92e5152aa6e8a9e21b9ac25a2"
    assert one(spark, f"https://p.files.example/star3/750_1024/{i}.png", assets.origin_url(x)) == f"https://p.files.example/star3/origin/{i}.jpg"
    for kept in (f"https://p.files.example/star3/origin/{i}.png", f"https://p.files.example/star4/abc/origin/{i}.png"):
        assert one(spark, kept, assets.origin_url(x)) == kept
    assert [one(spark, v, assets.origin_url(x)) for v in (f"https://p.files.example/star/{i}.png", "no url", None)] == ["", "", ""]


def test_answer_images(spark):
    x, good = F.col("x"), F.lit(True)
    for name, kept in (("silicon.png", True), ("a/icon.png", False), ("my_logo_2.png", False), ("heading.png", True), ("btn", False), (None, True)):
        assert one(spark, name, assets.answer_image(good, F.lit(9000), x)) is kept, name


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "a int, b int")
    got = {r["id"]: r["component"] for r in components(e, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50}


def test_overlay_and_sides(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    other = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert {tuple(r) for r in rows.overlay(base, other, "k", ["v"]).collect()} == {(1, "a"), (2, "x")}
    assert rows.both_sides(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "b").count() == 2
    assert {tuple(r) for r in rows.marked(base, other, "k").select("k", "known").collect()} == {(1, False), (2, True)}
