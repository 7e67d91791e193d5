"""Personal data in free text, found and replaced: a skip-chain conditional random field.

The variables of a document's field are its candidate mentions: everything with the shape of an e-mail
address, phone number, identity number, street address or person's name.  A variable says whether the
candidate is what it looks like.  Its own potential is log-linear in features of the mention: how far its form
tells (validity, check characters), how the words before it go with its kind, and for names the weight of their
characters and words.  Chain edges join neighbours: overlapping candidates can't hold together, and mentions
that stand side by side speak for each other.  Skip edges join mentions anywhere in the document whose text is
the same or begins alike, and pull them to the same answer; every place of a text that repeats an announced
name is a candidate with a skip edge to it, whatever its characters.  Loopy belief propagation passes messages
over both kinds of edges, and the beliefs decide.

What is learned, each over all texts:

* which characters and words are commoner inside names than outside them, at names that a plain cue announces
  (``CUES``: words as 姓名 or author, of no special kind of text);
* which words stand before each kind: at mentions that the form or those characters make sure, against
  candidates of the same kind that they rule out.  So the cues of a kind of text are found, not listed.

The weights of the features, of the chain and of the skip edges are fitted by pseudo-likelihood (each candidate
given its neighbours' labels) on the candidates of about ``SAMPLE`` texts, drawn by their hash from all of them,
with labels from announcements, their repeats, and check characters; weights that the sample tells little about
stay near their start.  Words and contexts without bound are kept as two rows of ``BUCKETS`` hashed counters, of
which the one nearer to that of an unknown key counts: none is left out, and what is broadcast has a fixed bound.

Cases: a null or empty text has no mentions and stays as it is; long texts are read whole; repeated rows
each get their own rows; without any announced name the weights stay at their start values.
Placeholders are [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [PERSON_NAME].
"""

from __future__ import annotations

import datetime
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import materialise

#: About so many texts are drawn to fit the weights on, and at most so many candidates of them are used.
SAMPLE, MOST_LABELLED = 20_000, 100_000
#: Hashed counters of a row; two rows for each table.
BUCKETS = 1 << 18
#: Rounds of messages.
ROUNDS = 6
KINDS = ("email", "phone", "id_number", "address", "person_name")

_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20}

# The first hundred and sixty surnames of the traditional list and some common ones beyond it.
SURNAMES = frozenset(
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳"
    "酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞"
    "熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍刘丁邓叶程曾崔陆石龙段侯孟白文"
)
COMPOUND = frozenset("司徒 上官 慕容 欧阳 端木 诸葛 皇甫 司马 东方 南宫 令狐 公孙 夏侯 尉迟 长孙 宇文 闻人 轩辕 独孤 百里 东郭 西门 呼延".split())
# Plain words that announce a name in any kind of text.
CUES_ZH = "姓名 真实姓名 作者 报告人 联系人 收件人 签名 署名 username name author".split()
CUES_EN = "committer|author|signed-off-by|name|dear|hello"
# What follows a place and never a name.
PLACE_ENDS = frozenset("省市区县镇乡村州湾路街巷弄道里港岛桥站机库")

_HAN = "[㐀-鿿]"
_EDGE = r"(?<![0-9A-Za-z_.\-])"
_AT = r"(?: ?@ ?| ?[\[({<] ?at ?[\])}>] ?| ?# ?at ?# ?)"
_DOT = r"(?: ?[\[({] ?dot ?[\])}] ?| ?# ?dot ?# ?| dot | ?\. ?(?=[A-Za-z0-9-]+ ?\. ?[A-Za-z]|(?:test|example|invalid|com|cn|org|net|edu)\b)|\.)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9_.+-])[A-Za-z0-9][A-Za-z0-9_.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-]|\.[A-Za-z0-9]|:[~/])", re.I)
SPELLED = re.compile(r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9][\w.+-]* +(?:AT|at) +[A-Za-z0-9-]+(?: +(?:DOT|dot) +[A-Za-z0-9-]+)+(?![A-Za-z0-9-])")
PHONE = re.compile(
    rf"{_EDGE}(?:"
    r"(?:\(?(?:\+|00)? ?86\)?[- ]?)?1[3-9]\d[- ]?\d{4}[- ]?\d{4}"
    r"|\(0\d{2,3}\) ?\d{3,4}[- ]?\d{4}|0\d{2,3}[- ]\d{3,4}[- ]?\d{4}|0\d{2}[1-9]\d{7}|0\d{3}[1-9]\d{6,7}|0\d{4} \d{3} ?\d{3}|00[1-9]\d{0,2}[ .-]?\d[\d .-]{6,14}\d"
    r"|\(?\+ ?[1-9]\d{0,2}\)?[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d[\d .-]{5,14}\d"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}-\d{3}-\d{4})"
    r"(?![0-9])"
)
ID_18 = re.compile(r"(?<![0-9A-Za-z])(?:\d[ -]?){17}[\dXx](?![0-9A-Za-z])")
DIGITS = re.compile(r"(?<![0-9A-Za-z.:/-])\d(?:[ -]?\d){6,14}(?![0-9A-Za-z:/-])")
PASSPORT = re.compile(r"(?<![0-9A-Za-z])(?:[DEGPS]\s?\d{8}|E[A-HJ-NP-Z]\s?\d{7})(?![0-9A-Za-z])")
STUDENT = re.compile(r"(?<![0-9A-Za-z.-])20 ?2 ?[1-4](?: ?\d){6}(?![0-9A-Za-z])(?!-\d)")
STREET_ZH = re.compile(
    rf"(?:{_HAN}{{2,5}}(?:省|自治区)\s?)?(?:{_HAN}{{2,4}}市\s?)?(?:{_HAN}{{2,4}}(?:区|县)\s?)?(?:{_HAN}{{2,4}}(?:镇|乡)\s?)?"
    rf"{_HAN}{{1,6}}(?:路|街|巷|弄|胡同|大道|道|里|坊)\s?\d{{1,5}}(?:\s?-\s?\d{{1,4}})?\s?(?:号|弄)"
    r"(?:\s?院)?(?:\s?\d{1,4}\s?(?:号楼|号院|号|栋|幢|座|楼|单元|室|层)){0,4}"
)
STREET_EN = re.compile(
    r"(?:(?:Flat|Apt\.?|Apartment|Unit|Room|Suite)[ ]?\d+[A-Za-z]?,?[ ]+)?(?:No\.?[ ]?)?(?:\d{1,5}[A-Za-z]?,?[ ]+)?(?:[A-Z][a-z']+[ ]+){1,3}"
    r"(?:Lane|Road|Street|Way|Close|Avenue|Drive|Row|Court|Place|Hill|Square|Terrace|Crescent|Gardens|Walk|Grove|Mews|Rd|St|Ave)\b\.?"
    r"(?:,?[ ]+\d{1,5}\b)?(?:,[ ]+[A-Z][a-z]+(?:[ ][A-Z][a-z]+)*){0,3}(?:,?[ ]+[A-Z]{1,2}\d{1,2}[A-Z]?[ ]\d[A-Z]{2})?"
)
# A house number before or behind words of a street of any name.
HOUSE = re.compile(r"(?<![\w.:/-])\d{1,4}[A-Za-z]?,? (?:(?:rue|via|calle|de|la|le|du|del|von|van|der|am|an) ){0,3}[A-ZÀ-Þ][a-zß-ÿ']+(?: (?:de|la|du|del|der) [A-ZÀ-Þ][a-zß-ÿ']+| [A-ZÀ-Þ][a-zß-ÿ']+){0,3}")
# Words before an address that aren't part of it.
_BEFORE_PLACE = re.compile(r"^(?:.*?(?:家住|寄往|寄回|寄到|请到|地址栏|常用地址|收件地址|写着|地址|地点|住在|送到|位于|往|到|在|是|为|点|着|至|给|了))(?=.)")
_CAP = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['’-][A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)?"
NAME_EN = re.compile(rf"(?<![A-Za-zÀ-ÿ])(?=({_CAP}(?: [A-Z]\.)? {_CAP}|{_CAP}, {_CAP}|[A-ZÀ-ÖØ-Þ]{{2,}} [A-ZÀ-ÖØ-Þ]{{2,}})(?![A-Za-zÀ-ÿ]))")
_SEED_ZH = re.compile(rf"(?:{'|'.join(sorted(CUES_ZH, key=len, reverse=True))})(?:者|为|是)?[\s:：=\"'>]{{1,4}}({_HAN}(?: ?{_HAN}){{1,3}})(?=[^㐀-鿿 ]|  | \(| \||$|\s\d)", re.I)
_SEED_EN = re.compile(rf"(?<![A-Za-z])(?:{CUES_EN})(?:[:：] ?| )({_CAP}(?:,? {_CAP})|[A-Z]{{2,}} [A-Z]{{2,}})(?![A-Za-zÀ-ÿ])", re.I)


def valid_18(digits: str) -> bool:
    """A real birth date, and the check character of the national standard: weights 2^(17-i) mod 11."""
    try:
        born = datetime.date(int(digits[6:10]), int(digits[10:12]), int(digits[12:14]))
    except ValueError:
        return False
    if not 1900 <= born.year <= 2030:
        return False
    left = sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(digits[:17])) % 11
    return digits[17].upper() == "10X98765432"[left]


_FIRSTS = "".join(sorted(SURNAMES | {c[0] for c in COMPOUND}))


def buckets(key: str) -> tuple[int, int]:
    """The counters of a key in the two rows; the same as :func:`hashed` gives in Spark."""
    h = xxhash.xxh64_intdigest(key.encode(), seed=42)
    return h & (BUCKETS - 1), (h >> 32) & (BUCKETS - 1)


@dataclass
class Lexicon:
    """What is learned: log-odds of characters (exact: there are only so many), of words and contexts (hashed),
    and the weights."""

    given: dict[str, float] = field(default_factory=dict)
    surname: dict[str, float] = field(default_factory=dict)
    words: tuple[dict[int, float], dict[int, float]] = ({}, {})
    contexts: tuple[dict[int, float], dict[int, float]] = ({}, {})
    # 1, mean and least odds of the given name, of the surname, cue, number beside, two characters, spaced, context
    zh: tuple[float, ...] = (-4.0, 0.6, 0.8, 0.2, 2.5, 0.5, 1.0, 1.0, 0.5)
    # 1, mean and least odds of the words, cue, inside an address, context
    en: tuple[float, ...] = (-4.0, 0.8, 0.8, 3.0, -3.0, 0.5)
    # how far the form tells, context
    form: tuple[float, ...] = (1.0, 1.0)
    chain: float = 0.3
    skip: float = 1.5
    _known: dict[str, float] = field(default_factory=dict)
    _starts: re.Pattern | None = None

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_starts": None}

    def starts(self) -> re.Pattern:
        """Where a surname stands before a character known from names, perhaps with blanks or as the first of two."""
        if self._starts is None:
            known = "".join(c for c, odds in self.given.items() if odds > UNSEEN) or "\0"
            self._starts = re.compile(rf"[{_FIRSTS}](?= ?[{known}]|. ?[{known}]| . ?[{known}])")
        return self._starts

    def _odds(self, rows: tuple[dict[int, float], dict[int, float]], key: str, unknown: float) -> float:
        out = self._known.get(key)
        if out is None:
            i, j = buckets(key)
            out = min(rows[0][i], rows[1][j], key=lambda odds: abs(odds - unknown)) if i in rows[0] and j in rows[1] else unknown
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[key] = out
        return out

    def word(self, word: str) -> float:
        return self._odds(self.words, "w" + word.lower(), UNSEEN)

    def context(self, kind: str, t: str, start: int) -> float:
        return self._odds(self.contexts, kind + " " + left_of(t, start), 0.0) if self.contexts[0] else 0.0


UNSEEN = -3.0

# Cheap signs without which the patterns can't match.
_IS_WIDE = re.compile("[\uff02-\uff0b\uff0d-\uff19\uff20-\uff5e\u3000\u00a0]")  # commas, colons and the like alone need no folding
_HAS_AT = re.compile(r"[\[({<#] ?[aA][tT] ?[\])}>#]")
_HAS_DIGITS = re.compile(r"\d[\d() -]{5,}\d")
_HAS_PHONE = re.compile(r"\d{3,5}[- )]{1,2}\d{3,4}|\d{10}|\+ ?\d")
_HAS_STREET_ZH = re.compile(r"[路街巷弄同道里坊] ?\d")
_HAS_STREET_EN = re.compile(r" (?:Lane|Road|Street|Way|Close|Avenue|Drive|Row|Court|Place|Hill|Square|Terrace|Crescent|Gardens|Walk|Grove|Mews|Rd|St|Ave)\b")
_HAS_HOUSE = re.compile(r"\d[A-Za-z]?,? (?:[A-ZÀ-Þ][a-zß-ÿ']|rue |via |calle |de |am |an )")
_HAS_PAIR = re.compile("[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]*(?: [A-Z]\\.)?,? [A-ZÀ-ÖØ-Þ]")
_CUES = sorted({*CUES_ZH, *CUES_EN.split("|")}, key=len)
_CAPITAL = re.compile("(?<![A-Za-zÀ-ÿ])[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+")
_DATE = re.compile(r"(?:19|20)\d\d(?:[- ]?(?:0[1-9]|1[0-2])[- ]?(?:0[1-9]|[12]\d|3[01])|[- ][1-9][- ]\d{1,2}|[- ]\d{1,2}[- ][1-9])(?!\d*-)(?:[- ]?(?:[01]\d|2[0-3]))?(?:[- ]?[0-5]\d){0,2}")
_FAMILY = re.compile(f"[{_FIRSTS}]")
_NUMERAL = re.compile(r"\d+")
_BETWEEN = " \t:：=（(“\"'<>,，|"


@dataclass
class Mention:
    """A candidate; ``sure`` tells that its form alone makes it one (1) or speaks against it (0), None that it tells little."""

    start: int
    end: int
    kind: str
    odds: float
    form: str
    features: tuple[float, ...] = ()
    sure: int | None = None
    announced: bool = False


def fold(text: str) -> str:
    """Plain width, character by character: places stay the same."""
    return text.translate(_FOLD) if _IS_WIDE.search(text) else text


def left_of(t: str, start: int) -> str:
    """What stands before a place: the last word, its digits as one, or the last two Chinese characters; '' at a text's beginning,
    a line break as itself."""
    end = start
    while end > 0 and t[end - 1] in _BETWEEN:
        end -= 1
    if not end:
        return ""
    c = t[end - 1]
    if "㐀" <= c <= "鿿":
        return t[max(0, end - 2) : end]
    if not c.isalnum():
        return c
    at = end - 1
    while at > 0 and end - at < 24 and t[at - 1].isascii() and t[at - 1].isalnum():
        at -= 1
    return _NUMERAL.sub("0", t[at:end].lower())


def shaped(t: str, lex: Lexicon) -> list[Mention]:
    """Candidates by form: numbers, e-mail addresses, street addresses.  The form gives a prior, the words
    before it the rest; forms that leave doubt are low and need their context or a like mention elsewhere."""
    out: list[Mention] = []
    w_form, w_context = lex.form

    def add(start: int, end: int, kind: str, prior: float, form: str, sure: int | None = None) -> None:
        x = (prior, lex.context(kind, t, start))
        out.append(Mention(start, end, kind, w_form * x[0] + w_context * x[1], form, x, sure))

    if "@" in t or _HAS_AT.search(t):
        for m in EMAIL.finditer(t):
            add(*m.span(), "email", 6.0, m[0].lower(), 1)
    if " dot " in t or " DOT " in t:
        for m in SPELLED.finditer(t):
            add(*m.span(), "email", 3.0, re.sub(" +dot +", ".", re.sub(" +at +", "@", m[0].lower())))
    digits_in = _HAS_DIGITS.search(t)
    if digits_in:
        for m in ID_18.finditer(t):
            digits = re.sub("[ -]", "", m[0])
            good = valid_18(digits)
            add(*m.span(), "id_number", 6.0 if good else -6.0, digits.upper(), int(good))
        for p, prior in ((PASSPORT, 4.0), (STUDENT, 2.5)):
            for m in p.finditer(t):
                add(*m.span(), "id_number", prior, m[0].replace(" ", ""), 1 if p is PASSPORT else None)
    if (digits_in or "+" in t) and _HAS_PHONE.search(t):
        for m in PHONE.finditer(t):
            digits = re.sub(r"\D", "", m[0])
            if 10 <= len(digits) <= 15:
                mobile = len(digits) >= 11 and digits[-11] == "1"
                add(*m.span(), "phone", 4.5 if mobile or not m[0][0].isdigit() else 3.5, digits, 1)
    if digits_in:
        taken = [(m.start, m.end) for m in out if m.odds > -5]
        for m in DIGITS.finditer(t):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                digits = re.sub(r"\D", "", m[0])
                add(*m.span(), "phone", -12.0 if _DATE.fullmatch(m[0]) else -4.0, digits, 0)
    if _HAS_STREET_ZH.search(t):
        for m in STREET_ZH.finditer(t):
            lead = _BEFORE_PLACE.match(m[0])
            start = m.start() + (lead.end() if lead else 0)
            add(start, m.end(), "address", 5.0, t[start : m.end()], 1)
    if _HAS_STREET_EN.search(t):
        for m in STREET_EN.finditer(t):
            if re.search(r"\d", re.sub(r"[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}", "", m[0])):
                add(*m.span(), "address", 5.0, m[0], 1)
    taken = [(m.start, m.end) for m in out]
    for m in HOUSE.finditer(t) if _HAS_HOUSE.search(t) else ():
        if not any(a < m.end() and m.start() < b for a, b in taken):
            add(*m.span(), "address", -2.0, m[0], 0)
    return out


def announced_names(t: str) -> list[tuple[int, int]]:
    low = t.lower()
    if not any(cue in low for cue in _CUES):
        return []
    return [m.span(1) for m in _SEED_ZH.finditer(t)] + [m.span(1) for m in _SEED_EN.finditer(t) if m[1][0].isupper()]


def split_name(name: str) -> tuple[str, str] | None:
    """Surname and given name of a Chinese name without blanks; any first character may be a surname."""
    first = 2 if name[:2] in COMPOUND or len(name) == 4 else 1
    return (name[:first], name[first:]) if 1 <= len(name) - first <= 2 else None


def name_candidates(t: str, lex: Lexicon, others: list[Mention], every: bool = False) -> list[Mention]:
    """Candidates whose characters or words are known from names, that a cue announces, or that repeat an
    announced one; with ``every`` also those that a surname or two capitals alone suggest."""
    out: list[Mention] = []
    given, rare = lex.given, UNSEEN
    seeds = set(announced_names(t))
    near = {m.start for m in others if m.kind != "address" and m.odds > 0}
    n = len(t)

    def chinese(i: int, j: int, surname: str, chars: str, spaced: bool) -> None:
        odds = [given.get(x, rare) for x in chars]
        place = j < n and t[j] in PLACE_ENDS
        cue = (i, j) in seeds
        beside = any(k in near for k in range(j, j + 4))
        x = (1.0, sum(odds) / len(odds), min(odds), lex.surname.get(surname, rare), float(cue), float(beside), float(len(chars) == 2), float(spaced), lex.context("person_name", t, i))
        score = sum(w * f for w, f in zip(lex.zh, x, strict=True)) - (20.0 if place else 0.0)
        out.append(Mention(i, j, "person_name", score, surname + chars, x, None, cue))

    placed = set()
    # The places that a cue names are looked at whatever the lexicon knows of them.
    first_at = _FAMILY if every or seeds else lex.starts()
    for family in first_at.finditer(t):
        i, c, first = family.start(), family[0], 0
        if t[i : i + 2] in COMPOUND:
            first = 2
        elif i + 2 < n and t[i + 1] == " " and c + t[i + 2] in COMPOUND:
            first = 3
        elif c in SURNAMES:
            first = 1
        if not first:
            continue
        for spaced in (False, True):
            j, chars = i + first, ""
            for _ in range(2):
                if spaced:
                    if j < n and t[j] == " ":
                        j += 1
                    else:
                        break
                if j >= n or not "㐀" <= t[j] <= "鿿":
                    break
                chars += t[j]
                j += 1
                if not every and given.get(t[j - 1], rare) <= rare and (i, j) not in seeds:
                    break
                placed.add((i, j))
                chinese(i, j, t[i : i + first].replace(" ", ""), chars, spaced)
    forms = {t[i:j] for i, j in seeds}
    for form in forms:
        bare = form.replace(" ", "")
        two = split_name(bare) if bare[0] >= "㐀" else None
        if two:
            # every place with the form of an announced name, whatever its surname
            i = t.find(form)
            while i >= 0:
                if (i, i + len(form)) not in placed:
                    placed.add((i, i + len(form)))
                    chinese(i, i + len(form), *two, " " in form)
                i = t.find(form, i + 1)
    for m in NAME_EN.finditer(t) if _HAS_PAIR.search(t) else ():
        name = m[1]
        parts = re.split("[ ,]+", name)
        odds = [lex.word(parts[0]), lex.word(parts[-1])]
        cue = m.span(1) in seeds
        if max(odds) <= rare and not (every or cue or name in forms):
            continue
        inside = any(o.start <= m.start(1) and m.end(1) <= o.end for o in others if o.kind == "address" and o.odds > 0)
        x = (1.0, sum(odds) / 2, min(odds), float(cue), float(inside), lex.context("person_name", t, m.start()))
        form = f"{parts[-1]} {parts[0]}".lower() if "," in name else f"{parts[0]} {parts[-1]}".lower()
        out.append(Mention(*m.span(1), "person_name", sum(w * f for w, f in zip(lex.en, x, strict=True)), form, x, None, cue))
    if every:
        return out
    # Of a name and the longer one that begins with it, the longer if it holds by itself.
    longest = {}
    for m in out:
        if m.odds > 0:
            longest[m.start] = max(longest.get(m.start, 0), m.end)
    return [m for m in out if m.end >= longest.get(m.start, 0)]


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


#: Candidates with at most so many characters between them stand side by side.
SIDE = 4


def edges_of(mentions: list[Mention]) -> list[tuple[int, int, str, float]]:
    """(i, j, sort, strength): ``clash`` between overlapping candidates, ``chain`` between those side by side,
    ``skip`` between each mention and the one before with the same text, or the last that begins alike."""
    order = sorted(range(len(mentions)), key=lambda k: (mentions[k].start, mentions[k].end))
    edges: list[tuple[int, int, str, float]] = []
    alive: list[int] = []
    for k in order:
        m = mentions[k]
        alive = [o for o in alive if mentions[o].end + SIDE >= m.start]
        for o in alive:
            if mentions[o].end > m.start:
                edges.append((o, k, "clash", 1.0))
            elif mentions[o].kind != m.kind:
                edges.append((o, k, "chain", 1.0))
        alive.append(k)
    last: dict[tuple[str, str], int] = {}
    for k in order:
        m, ties = mentions[k], {}
        for form in {m.form, m.form[:2]} if m.kind == "person_name" else {m.form}:
            o = last.get((m.kind, form))
            if o is not None and mentions[o].end <= m.start:
                ties[o] = 1.0 if mentions[o].form == m.form else 1 / 3
            last[(m.kind, form)] = k
        edges += [(o, k, "skip", strength) for o, strength in ties.items()]
    return edges


def settle(mentions: list[Mention], skip: float, chain: float = 0.0, rounds: int = ROUNDS) -> list[float]:
    """Log-odds of each candidate after ``rounds`` of messages over chain and skip edges."""
    edges = edges_of(mentions)
    belief = [m.odds for m in mentions]
    if not edges:
        return belief
    sent = {(a, b, s): 0.0 for i, j, s, _ in edges for a, b in ((i, j), (j, i))}
    for _ in range(rounds):
        change, fresh = 0.0, {}
        for i, j, sort, strength in edges:
            for a, b in ((i, j), (j, i)):
                h = max(-30.0, min(30.0, belief[a] - sent[(b, a, sort)]))
                if sort == "skip":
                    w = skip * strength
                    out = _softplus(h + w) - (_softplus(h - w) + w)
                elif sort == "chain":
                    out = _softplus(h + chain) - _softplus(h)
                else:
                    out = -_softplus(h)
                fresh[(a, b, sort)] = out
        for key, value in fresh.items():
            change = max(change, abs(value - sent[key]))
            belief[key[1]] += value - sent[key]
            sent[key] = value
        if change < 1e-3:
            break
    return belief


def candidates(t: str, lex: Lexicon) -> list[Mention]:
    """The variables of a text's field.  One that stays below even odds with all that its edges can bring, at most
    two skip edges by its text, two by its beginning and a chain edge to either side, can't hold and is left out."""
    found = shaped(t, lex)
    found += name_candidates(t, lex, found)
    if all(m.odds + 2 * lex.chain >= 0 for m in found):
        return found
    like = Counter((m.kind, form) for m in found for form in ({m.form, m.form[:2]} if m.kind == "person_name" else {m.form}))
    alone = lambda m: like[(m.kind, m.form[:2] if m.kind == "person_name" else m.form)] == 1
    return [m for m in found if m.odds + 2 * lex.chain + (0.0 if alone(m) else lex.skip * 8 / 3) >= 0]


def mentions_in(text: str, lex: Lexicon) -> list[Mention]:
    """The accepted mentions in order; none overlap."""
    found = candidates(fold(text), lex)
    if not found:
        return []
    belief = settle(found, lex.skip, lex.chain)
    taken: list[Mention] = []
    for k in sorted(range(len(found)), key=lambda k: (-belief[k], found[k].start)):
        m = found[k]
        if belief[k] > 0 and all(m.end <= o.start or o.end <= m.start for o in taken):
            taken.append(m)
    return sorted(taken, key=lambda m: m.start)


def replaced(text: str, mentions: list[Mention]) -> str:
    out, at = [], 0
    for m in mentions:
        out += [text[at : m.start], f"[{m.kind.upper()}]"]
        at = m.end
    return "".join([*out, text[at:]])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (text): how often each character and word occurs in announced names (inside) and at all."""
    for batch in batches:
        inside, chars, words = Counter(), Counter(), Counter()
        for text in batch.column(0).to_pylist():
            t = fold(text)
            chars.update(t)
            words.update(_CAPITAL.findall(t))
            for i, j in announced_names(t):
                name = t[i:j].replace(" ", "") if t[i] >= "㐀" else ""
                if not name:
                    inside.update("w" + w.lower() for w in re.split("[ ,]+", t[i:j]))
                elif two := split_name(name):
                    inside["s" + two[0]] += 1
                    inside.update("g" + c for c in two[1])
        every = Counter({"c" + c: n for c, n in chars.items() if "㐀" <= c <= "鿿"})
        for w, n in words.items():
            every["w" + w.lower()] += n
        yield keyed_counts([(k, n, 0) for k, n in inside.items()] + [(k, 0, n) for k, n in every.items()])


COUNTS = "key string, inside long, other long"


def keyed_counts(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["key", "inside", "other"])


def context_counter(lex: Lexicon):
    """For mapInArrow over (text): what stands before mentions that are sure (inside) and before candidates of
    the same kind that are ruled out (other)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure, ruled_out = Counter(), Counter()
            for text, n in Counter(batch.column(0).to_pylist()).items():
                t = fold(text)
                shapes = shaped(t, lex)
                for m in shapes:
                    if m.sure is not None:
                        (sure if m.sure else ruled_out)[f"{m.kind} {left_of(t, m.start)}"] += n
                names = name_candidates(t, lex, shapes, every=True)
                good = [m for m in names if m.announced or m.features[2] > 1.0]
                spans = {(m.start, m.end) for m in good}
                for m in names:
                    if (m.start, m.end) in spans:
                        sure[f"person_name {left_of(t, m.start)}"] += n
                    elif m.features[2] < 0 and not any(g.start < m.end and m.start < g.end for g in good):
                        ruled_out[f"person_name {left_of(t, m.start)}"] += n
            yield keyed_counts([(k, n, 0) for k, n in sure.items()] + [(k, 0, n) for k, n in ruled_out.items()])

    return count


def hashed(counts: DataFrame) -> list:
    """Counts by row and counter: at most 2 x ``BUCKETS`` rows, whatever the number of keys."""
    h = F.xxhash64("key")
    both = F.array(*[F.struct(F.lit(k).alias("row"), F.shiftrightunsigned(h, 32 * k).bitwiseAND(F.lit(BUCKETS - 1)).alias("at")) for k in (0, 1)])
    spread = counts.select("inside", "other", F.inline(both))
    return spread.groupBy("row", "at").agg(F.sum("inside").alias("inside"), F.sum("other").alias("other")).where("inside > 0 or other > 0").collect()


def odds_of(inside: int, other: int, all_inside: int, all_other: int, low: float, high: float) -> float:
    """Log-odds of a key against those of all keys, drawn towards 0 where it was seen once or twice."""
    p = (all_inside + 0.5) / (all_inside + all_other + 1)
    odds = math.log((inside + p) / (other + 1 - p)) - math.log(p / (1 - p))
    seen = inside + min(other, inside + 2)
    return max(low, min(high, odds * seen / (seen + 1)))


def lexicon_of(texts: DataFrame) -> Lexicon:
    """Count over all ``texts`` (one column), then fit the weights on a bounded sample of them."""
    summed = lambda df: df.groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("other").alias("other"))
    counts = materialise(summed(texts.mapInArrow(counted, COUNTS)), "counts")
    sort = F.left("key", F.lit(1))
    sums = {r["sort"]: r for r in counts.groupBy(sort.alias("sort")).agg(F.sum("inside").alias("inside"), F.sum("other").alias("other")).collect()}
    total = lambda k, c: (sums[k][c] or 0) if k in sums else 0
    lex = Lexicon()
    # Characters: as many rows as there are Chinese characters, twice.
    of_names = counts.where(sort.isin("g", "s")).select(sort.alias("sort"), F.expr("substring(key, 2)").alias("k"), "inside")
    overall = counts.where(sort == "c").select(F.expr("substring(key, 2)").alias("c"), "other")
    for r in of_names.join(overall, F.left("k", F.lit(1)) == F.col("c"), "left").select("sort", "k", "inside", "other").collect():
        table = lex.given if r["sort"] == "g" else lex.surname
        table[r["k"]] = odds_of(r["inside"], max(0, (r["other"] or 0) - r["inside"]), total(r["sort"], "inside"), total("c", "other"), UNSEEN, 6.0)
    lex.words = ({}, {})
    for r in hashed(counts.where(sort == "w")):
        if r["inside"]:
            lex.words[r["row"]][r["at"]] = odds_of(r["inside"], max(0, r["other"] - r["inside"]), total("w", "inside"), total("w", "other"), UNSEEN, 6.0)
    contexts = materialise(summed(texts.mapInArrow(context_counter(lex), COUNTS)), "contexts")
    kinds = {r["kind"]: r for r in contexts.groupBy(F.substring_index("key", " ", 1).alias("kind")).agg(F.sum("inside").alias("inside"), F.sum("other").alias("other")).collect()}
    learned: tuple[dict[int, float], dict[int, float]] = ({}, {})
    for kind, n in kinds.items():
        if n["inside"] and n["other"]:
            for r in hashed(contexts.where(F.substring_index("key", " ", 1) == kind)):
                learned[r["row"]][r["at"]] = odds_of(r["inside"], r["other"], n["inside"], n["other"], -3.0, 3.0)
    lex.contexts, lex._known = learned, {}
    n = texts.count()
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)))
    sample = drawn.mapInArrow(labelled(lex), "of string, x array<double>, y int").limit(MOST_LABELLED).collect()
    fit(lex, sample)
    return lex


def labels_of(found: list[Mention]) -> list[int | None]:
    """1 for what the form makes sure, for announced names of known characters and for what repeats their text;
    0 for what the form or the characters rule out; None for the rest."""
    said = {m.form for m in found if m.announced}
    forms = {m.form for m in found if m.announced and m.features[2] > 0}
    out: list[int | None] = []
    for m in found:
        if m.kind != "person_name":
            out.append(m.sure)
        elif m.form in forms:
            out.append(1)
        else:
            out.append(0 if m.features[2] < 0 and m.form not in said else None)
    return out


def labelled(lex: Lexicon):
    """For mapInArrow over (text): for each labelled candidate its features, and the sums over its chain and
    skip neighbours' labels."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, xs, ys = [], [], []
            for text in batch.column(0).to_pylist():
                t = fold(text)
                shapes = shaped(t, lex)
                found = shapes + name_candidates(t, lex, shapes, every=True)
                known = labels_of(found)
                # Of candidates that begin at one place, the true one rules out the others; they tell nothing.
                true = [m for m, y in zip(found, known, strict=True) if y == 1]
                chain, skip = [0.0] * len(found), [0.0] * len(found)
                for i, j, sort, strength in edges_of(found):
                    for a, b in ((i, j), (j, i)):
                        if sort == "chain" and known[b]:
                            chain[a] += 1.0
                        elif sort == "skip" and known[b] is not None:
                            skip[a] += strength * (2 * known[b] - 1)
                for k, (m, y) in enumerate(zip(found, known, strict=True)):
                    if y is None or y == 0 and any(o.start < m.end and m.start < o.end for o in true):
                        continue
                    of.append("form" if m.kind != "person_name" else "zh" if m.form[0] >= "㐀" else "en")
                    xs.append([*m.features, chain[k], skip[k]])
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["of", "x", "y"])

    return label


#: The feature that the labels come from, kept out of the fit.
_MASKED = {"zh": 4, "en": 3, "form": 0}


def fit(lex: Lexicon, sample: list) -> None:
    """Fit the weights of each sort of candidate, then those of the edges as the mean over the sorts."""
    edges = []
    for of in ("zh", "en", "form"):
        rows = [r for r in sample if r["of"] == of]
        start = np.array([*getattr(lex, of), lex.chain, lex.skip])
        y = np.array([r["y"] for r in rows], float)
        if 0 < y.sum() < len(y):
            w = fitted(np.array([r["x"] for r in rows]), y, start, _MASKED[of])
            setattr(lex, of, tuple(w[:-2]))
            edges.append(w[-2:])
    if edges:
        lex.chain, lex.skip = (float(max(0.0, v)) for v in np.mean(edges, axis=0))


def fitted(x: np.ndarray, y: np.ndarray, start: np.ndarray, masked: int, steps: int = 200, decay: float = 0.01) -> tuple[float, ...]:
    """Pseudo-likelihood by gradient descent, held towards ``start``: the log-odds of a candidate given its
    neighbours' labels are its own features and the sums over its chain and skip edges.  The weight of the
    masked feature stays: the labels come from it."""
    x = x.copy()
    x[:, masked] = 0.0
    w = start.copy()
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (balance * (p - y)) + decay * (w - start))
    w[masked] = start[masked]
    return tuple(float(v) for v in w)


def tagger(lex: Lexicon):
    """For mapInArrow over (field, row, text): a row for each mention, and the text with placeholders."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, clean, done = [], [], {}
            for text in batch.column(2).to_pylist():
                if text not in done:
                    found = mentions_in(text, lex) if text else []
                    done[text] = [{"kind": m.kind, "start": m.start, "end": m.end} for m in found], replaced(text, found) if text else text
                kinds.append(done[text][0])
                clean.append(done[text][1])
            spans = pa.array(kinds, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, pa.array(clean, pa.string())], names=["field_name", "row_id", "mentions", "redacted"])

    return tag


def tagged(texts: DataFrame) -> DataFrame:
    """(field_name, row_id, mentions, redacted) from (field_name string, row_id, text)."""
    lex = lexicon_of(texts.select("text").where(F.col("text").isNotNull()))
    row = dict(texts.dtypes)["row_id"]
    schema = f"field_name string, row_id {row}, mentions array<struct<kind:string,start:int,end:int>>, redacted string"
    return texts.select("field_name", "row_id", "text").mapInArrow(tagger(lex), schema)


def review_texts(drafts: DataFrame, vision: DataFrame) -> DataFrame:
    """The three free-text fields as rows."""
    of_drafts = drafts.select("draft_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("draft_comment", "basis")])))
    both = of_drafts.select("field_name", F.col("draft_id").alias("row_id"), "text")
    seen = vision.select(F.lit("extracted_text").alias("field_name"), F.col("vision_id").alias("row_id"), F.col("extracted_text").alias("text"))
    return both.union(seen)


def personal_data(drafts: DataFrame, vision: DataFrame) -> DataFrame:
    found = tagged(review_texts(drafts, vision)).select("field_name", "row_id", F.explode("mentions").alias("m"))
    return found.select("field_name", "row_id", F.col("m.kind").alias("kind")).distinct()


def redacted_texts(drafts: DataFrame, vision: DataFrame) -> DataFrame:
    """Each text with typed placeholders, and how many mentions were replaced."""
    return tagged(review_texts(drafts, vision)).select("field_name", "row_id", F.size("mentions").alias("replaced"), "redacted")
