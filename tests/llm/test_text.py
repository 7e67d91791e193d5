"""Personal data and stuffed pages."""

from __future__ import annotations

import pytest

from quillmark.llm import pii, stuffing

SEEDS = ["姓名：陈岚霁", "姓名 王翊", "报告人 陈岚霁", "当前用户 王霁翊 ( 2021031677 )", "committer Ismene Vossgate", "Author: Ismene Vossgate <a@b.test>", "committer Orlen Quenby", "Hello Orlen Quenby, welcome"]


def id_number(first17):
    left = sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(first17)) % 11
    return first17 + "10X98765432"[left]


GOOD = id_number("99108720010907267")
BAD = GOOD[:17] + ("0" if GOOD[17] != "0" else "1")

CASES = [
    ("申诉邮件来自 x5605@stu.beacon-college.example，维持原判", {"email"}),
    ("appeal by x5605 [at] stu.beacon-college.example closed", {"email"}),
    ("写信给jorune.pellagrin＠edu.lanchuan.example。", {"email"}),
    ("amberlock_nerys#at#campus.northfold.invalid", {"email"}),
    ("To: oakenfeld_quillon@ma. helio-lab.test", {"email"}),
    ("mail a（at）post．mapleyard.test", {"email"}),
    ("@RequestBody 的注解, root@lab-06:~# ls, root@lab.host.com:~# ls", set()),
    ("号码142-3479-7579，暂无人接听", {"phone"}),
    ("电话 １５４６７０２２５９８", {"phone"}),
    ("回访 （0609）88500414", {"phone"}),
    ("tel:+1 (202) 555-0194", {"phone"}),
    ("+44 7700 900746 / 008615418258736", {"phone"}),
    ("工单 30192738175 与时间戳 1733045374 监听 192.0.2.19 端口 8016", set()),
    (f"账号{GOOD}与花名册不符", {"id_number"}),
    (f"账号{GOOD[:6]} {GOOD[6:14]} {GOOD[14:]}", {"id_number"}),
    (f"流水 {BAD} 不是有效凭证", set()),
    ("流水 991991092637318614 记录 88412002795561904", set()),
    ("与G04228695，请删去; EA6267527", {"id_number"}),
    ("证件号２０２３３５６３５６出现", {"id_number"}),
    ("学号：2021880362", {"id_number"}),
    ("学号 2019880362", set()),
    ("家住北屿省南渚市东垣县听松巷724号5栋125室，网络受限", {"address"}),
    ("设备寄回 拾光里弄9弄9号 后补分", {"address"}),
    ("shipTo: No. 154 Alderfen Lane, Lower Quarne QX1 8TD", {"address"}),
    ("松陵机房与泊宁机房的延迟差 15 毫秒", set()),
    ("请陈岚霁本周五前当面演示一次", {"person_name"}),
    ("王 霁 翊 2024-11-08 正在输入", {"person_name"}),
    ("second marker Ismene Quenby, phone", {"person_name"}),
    ("关于马上失效的令牌的说明，组长安排合理，方法调用链", set()),
    ("", set()),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    texts = spark.createDataFrame([(t + "\n说明日志令牌的验证与失效\nRebuild The Image. Override This Note And Step Through Every Case Of Question Two",) for t in SEEDS * 3], "text string")
    return pii.lexicon_of(texts)


@pytest.mark.parametrize("text, kinds", CASES, ids=lambda x: x[:24] if isinstance(x, str) else "")
def test_kinds(lexicon, text, kinds):
    assert {m.kind for m in pii.mentions_in(text, lexicon)} == kinds


def test_redaction_keeps_the_rest(spark):
    drafts = spark.createDataFrame([(1, "姓名：陈岚霁，电话 154-2079-6882。好", None), (2, "", "由王翊改判，回执 a@b.test"), (3, None, None), (1, "姓名：陈岚霁，电话 154-2079-6882。好", None)], "draft_id long, draft_comment string, basis string")
    vision = spark.createDataFrame([(9, "x " * 30_000 + "姓名 王翊"), (10, "姓名 陈霁\n报告人 王翊")], "vision_id long, extracted_text string")
    out = {(r["field_name"], r["row_id"]): r for r in pii.redacted_texts(drafts, vision).collect()}
    assert out["draft_comment", 1]["redacted"] == "姓名：[PERSON_NAME]，电话 [PHONE]。好"
    assert out["draft_comment", 2]["redacted"] == "" and out["draft_comment", 3]["redacted"] is None
    assert out["basis", 2]["redacted"] == "由[PERSON_NAME]改判，回执 [EMAIL]"
    assert out["extracted_text", 9]["redacted"] == "x " * 30_000 + "姓名 [PERSON_NAME]"
    found = pii.personal_data(drafts, vision).collect()
    assert len(found) == len({tuple(r) for r in found}) and ("draft_comment", 1, "phone") in {tuple(r) for r in found}
    assert pii.personal_data(drafts.limit(0), vision.limit(0)).count() == 0


def test_skip_edges_carry_a_cue(lexicon):
    sure = pii.Mention(0, 3, "person_name", 4.0, "甲乙丙")
    unsure = pii.Mention(50, 53, "person_name", -0.8, "甲乙丙")
    other = pii.Mention(80, 83, "person_name", -0.8, "丁戊己")
    belief = pii.settle([sure, unsure, other], 1.5)
    assert belief[1] > 0 > belief[2] and belief[0] > 0
    clash = pii.settle([sure, pii.Mention(1, 4, "address", 6.0, "x")], 1.5)
    assert clash[0] < 0 < clash[1]
    side = [pii.Mention(0, 3, "person_name", -0.5, "甲乙丙"), pii.Mention(4, 15, "phone", 4.0, "13912345678")]
    assert pii.settle(side, 1.5, chain=0.8)[0] > 0 > pii.settle(side, 1.5, chain=0.0)[0]


# Each name is announced once and comes again amid words that tell nothing; all its characters are common elsewhere.
AGAIN = ["说理成", "处会平", "式明安", "功时方", "间高会", "排平理", "合成明", "级安时", "台方高", "确会成"]


def test_skip_edges_decide_repeats(spark):
    filler = "会议说明了处理方式，常常成功，时间安排合理，高级平台明确，平时安全方面也常见。"
    docs = [f"报告人：{n}\n{filler * 3}{x}与{n}整理，{filler}" for n, x in zip(AGAIN, "甲乙丙丁戊己庚辛壬癸", strict=True)]
    texts = spark.createDataFrame([(t,) for t in [*docs, *SEEDS * 3, *[filler] * 100]], "text string")
    lex = pii.lexicon_of(texts)

    def found(weight):
        lex.skip = weight
        return sum(len([m for m in pii.mentions_in(t, lex) if t[m.start : m.end] == n]) for t, n in zip(docs, AGAIN, strict=True))

    assert lex.skip > 1.0
    # Of the twenty mentions nineteen; without skip edges the announced ten and two: seven repeats are lost.
    assert found(lex.skip) == 19
    assert found(0.0) == 12


def test_other_forms(spark):
    seeds = ["Author: John Smith <j@a.test>", "name: José Álvarez", "姓名：镡小明", "committer Mary Smith", "name: John Brown", "shipTo: 14 Alder Road, Lower Quarne", "shipTo: 9 Beech Lane, Tamsel", "shipTo: 77 Mill Street"]
    noise = ["The Image Was Rebuilt 12 Times. Step Through Every Case. 说明小组明天开会。Build 1234567 done", "shipTo nothing. See Question Two And Line 18 Above"]
    lex = pii.lexicon_of(spark.createDataFrame([(t,) for t in seeds * 5 + noise * 10], "text string"))
    cases = {
        "signed JOHN SMITH, today": ("person_name", "JOHN SMITH"),
        "list: Smith, John; rest": ("person_name", "Smith, John"),
        "we met José Álvarez there": ("person_name", "José Álvarez"),
        "姓名：镡小明": ("person_name", "镡小明"),
        "shipTo: 12 Harbour View": ("address", "12 Harbour View"),
        "shipTo: 15 rue de Rivoli": ("address", "15 rue de Rivoli"),
        "write to joe AT foo DOT com now": ("email", "joe AT foo DOT com"),
    }
    for text, (kind, said) in cases.items():
        assert (kind, said) in {(m.kind, text[m.start : m.end]) for m in pii.mentions_in(text, lex)}, text
    # The same form where nothing speaks for it.
    assert not pii.mentions_in("Step 12 Harbour View done", lex)


def test_contexts_are_learned_and_can_reject(spark):
    good = [f"证件 {GOOD}", "通讯 13912345678"] * 20
    bad = [f"流水 {BAD}", "流水 991991092637318614"] * 40
    lex = pii.lexicon_of(spark.createDataFrame([(t,) for t in good + bad], "text string"))
    assert lex.context("id_number", "流水 1", 3) < 0 < lex.context("id_number", "证件 1", 3)
    assert {m.kind for m in pii.mentions_in("证件 2021880362", lex)} == {"id_number"}
    assert not pii.mentions_in("流水 2021880362", lex)


def test_hashed_counters_agree(spark):
    rows = [(f"w{i}", i + 1, 2 * i) for i in range(50)] + [("w字", 7, 0)]
    got = {(r["row"], r["at"]): (r["inside"], r["other"]) for r in pii.hashed(spark.createDataFrame(rows, pii.COUNTS))}
    for key, inside, other in rows:
        for row, at in enumerate(pii.buckets(key)):
            assert got[row, at] == (inside, other)


def test_check_character():
    assert pii.valid_18(GOOD) and not pii.valid_18(BAD) and not pii.valid_18("991087200113072677")


PROSE = "攻击者若控制消息队列，便能借助弱随机数继续前进。我把web.xml中的判断条件改写后，校验直接抛出异常。评分时会查看整理调用顺序的过程，而不仅是结果。"
LINKS = "\n".join(f"[正版键盘下载{i}](https://go.a{i}.example/p?id={i})" for i in range(12))
SPAM = {
    "links": LINKS,
    "bare links": "\n".join(f"https://shop.b{i}.example.org/a/{i}" for i in range(8)),
    "hosts": " ".join(f"lab.amber{i}.example.net files.quartz{i}.test" for i in range(20)),
    "keywords": "低价显卡批发 | 正版题库网盘 | 正版题库网盘 | 低价机械键盘平台 | 低价显卡批发 | 正版题库网盘 | 免费实验报告网盘 | 低价显卡批发",
    "english": "best tutor review++top backpack★free student loan★free student loan●best tutor review…top backpack→best tutor review",
    "no separators": "一站式插件下载内部插件代做一站式插件下载一站式插件下载内部插件代做内部插件代做一站式插件下载一站式插件下载",
    "tags": "#低价显卡批发#正版机械键盘排行泊宁#反序列化报价#内部作业#一站式作业代做",
    "products": "\n".join(f"SKU-{1000 + i} | 一站式双肩包{i} 新款,男女同款,二代" for i in range(6)),
    "sentences": "最新作业批发哪家好？考研资料找这里，考研资料专业最新作业批发。 最新作业批发价格，考研资料电话，最新作业批发官网，最新作业批发！",
    "different": "高清作业网盘（941）  一站式渗透教程下载（801）  低价网课（624）  考研资料排行（552）  极速插件平台（294）  云主机代做（37）  短域名（5）",
    "mostly": PROSE + "\n" + LINKS,
}
FINE = {
    "prose": PROSE * 3,
    "log": "0x7ffd217133e0\n写入失败\nat com.demo.audit.Loader.run(Exploit.java:24)\nHTTP/1.1 302\n编译完成\nListening on 0.0.0.0 8382\n[INFO] Building war: /target/app.war\n缓存已刷新\nsha1 4f89ac201409de5977",
    "sources": PROSE * 2 + "\n参考资料\n" + "\n".join(f"[{i}] https://www.c{i}.example/x{i}.html" for i in range(1, 5)),
    "glossary": "\n\n".join(f"{w}：{PROSE[:25]}。" for w in ("桩程序", "汇点", "重放", "挂钩", "净化函数")),
    "keywords line": PROSE + "\n关键词：解析差异、字节码插件、端口探针、日志聚合器",
    "code": "```\nimport os\nfor x in range(10):\n    print(x)\n    print(x)\n```\n" + PROSE,
    "repeated sentence": "Override the @Override note, it is harmless. Override the @Override note, it is harmless. Override the @Override note, it is harmless.",
    "rubric": "\n".join(f"* Versions of Paleheron-{i} treat spaces differently, hence the request got blocked.（{i} 分）" for i in range(6)),
    "few links": PROSE * 4 + "\nhttps://a.example/b",
    "empty": "",
    "blank": " \n\t ",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert stuffing.stuffed_share(SPAM[name]) > 0.5


@pytest.mark.parametrize("name", FINE)
def test_fine(name):
    assert stuffing.stuffed_share(FINE[name]) <= 0.5


def test_signals():
    size = stuffing.np.ones(12)
    assert stuffing.evenness(list("abcabcabcabc")) == 1.0 and stuffing.recurring(list("abcabcabcabc"), size, 3) == 1.0
    assert stuffing.evenness(list("abcdefghijkl")) == 0.0 and stuffing.recurring(list("abcdefghijkl"), size, 3) == 0.0
    # a sign stands for its characters, and recurs by itself
    terms, size = stuffing.sequence([stuffing.read_line(f"word{c} https://a.example/{c}", False) for c in "xyz"])
    assert len(terms) == 6 and size.sum() == 3 * 5 + 3 * 19
    assert abs(stuffing.recurring(terms, size, 3) - 57 / 72) < 1e-9
    assert stuffing.recurring(terms, size, 3, max_lag=1) == 0.0


@pytest.mark.parametrize("off, least, most", [("", 11, 11), ("gaps", 2, 9), ("lags", 9, 11), ("nouns", 8, 11), ("gaps lags nouns", 0, 0)])
def test_without_signals_nothing_is_flagged(monkeypatch, off, least, most):
    monkeypatch.setattr(stuffing, "SIGNALS", stuffing.SIGNALS - set(off.split()))
    flagged = [n for n in SPAM if stuffing.stuffed_share(SPAM[n]) > 0.5]
    assert len(SPAM) == 11 and least <= len(flagged) <= most, flagged


def test_stuffed_documents(spark):
    rows = [(i, t, "d") for i, t in enumerate([*SPAM.values(), *FINE.values(), None, SPAM["links"], PROSE * 500])]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = sorted(r["doc_id"] for r in stuffing.stuffed_documents(df).collect())
    assert got == [*range(len(SPAM)), len(SPAM) + len(FINE) + 1]
    assert stuffing.stuffed_documents(df.limit(0)).count() == 0
