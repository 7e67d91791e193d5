"""Keyword-stuffed and link-list pages, by how their terms recur.

A page is read as a sequence of terms: words and Chinese characters, and in place of each link, host, tag and
product number the sign of its class, with the characters it stands for.  Lines whose sentences or function
words say that they are prose, and machine output (by shape, inside a fence, or a bare status line among such
lines), are told apart first; what is left are blocks of terms, and sentences with few function words.  Three
signals judge a block, each over its characters:

* recurrence gaps: the share of the block in terms (signs, and runs of ``RUN`` words or characters) that come
  again at gaps of at most ``MAX_LAG`` places;
* positional autocorrelation: the share of places that hold the same term as the place a lag before, at the best
  lag of the window;
* distinct nouns: many short items next to no function words, all different.

The shapes of links, hosts, tags and products only cut the text into terms; without the three signals no page is
flagged.  A page is flagged when more than half of its characters lie in blocks that a signal holds for lists.

Cases: a null, empty or blank text is never flagged; lists of sources under prose, glossaries, logs, code
and terminal output don't count; repeated documents are judged each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.5
MAX_LAG = 64
#: Words, or Chinese characters, of a run that counts as one recurring term.
RUN_WORDS, RUN_CHARS = 3, 4
#: Which signals are looked at.
SIGNALS = frozenset({"gaps", "lags", "nouns"})
#: Lines of context on either side in which the kind of a short line is settled.
AROUND = 3

# Function words and characters, taken as closed classes of the two languages.
FUNCTION_EN = frozenset(
    "the a an of to and or but in on at by for with from into onto as is are was were be been being am it its this that these those "
    "not no nor so if then than when while because before after unless until since once only would could should may might must can "
    "will shall do does did has have had he she we they you i our your his her their my me us them there here what which who whom "
    "how why where each every some any all both either neither more most less very just yet still also too upon between through over "
    "under out up down off about against during without within another such same other".split()
)
FUNCTION_ZH = frozenset("的了是在和与或被把从将不也都就着过而且但因所以若如果为其这那此之于对向并及有没会能可应须请先后再又只才却虽然则即已")

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"'）)\]，。、|]+", re.I)
_HOST = re.compile(r"(?<![\w@./-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.){1,}[a-z]{2,}(?:\.[a-z]{2,})?(?![\w/(:.-])", re.I)
_FILE = re.compile(r"\.(?:java|jsp|xml|py|sh|md|php|war|bin|jar|txt|html?|js|ts|json|ya?ml|log|class|go|rs|c|cpp|h|png|jpe?g|pdf|zip|exe)$", re.I)
_MARKUP = re.compile(r"<a\s[^>]*>|</a>|\]\(|<[a-z/][^>]*>|[\[\]()<>]", re.I)
_REFERENCE = re.compile(r"^\s*[\[（(]?\d{1,3}[\]）).、]\s*\S*.*(?:https?://|www\.)", re.I)
_TAG = re.compile(r"#[^\s#,，、|;]+")
_PRODUCT = re.compile(r"(?<![\w-])[A-Za-z]{2,8}-\d{3,}(?![\w-])")
_MACHINE = re.compile(
    r"^\s*at [\w.$<>]+\(|[\w-]+@[\w.-]+:[~/]|0x[0-9a-f]{6,}|\b(?:sha1|sha256|md5|trace-id)\b|HTTP/\d|\b(?:GET|POST|PUT|DELETE|HEAD|PATCH) /"
    r"|\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}|\[(?:INFO|WARN|ERROR|DEBUG|TRACE|[+*!-])\]|\b\d{1,3}(?:\.\d{1,3}){3}\b|\bversion \"|^\s*@\w+\(?"
    r"|^\s*(?:docker|mvn|git|curl|wget|nc|java|python3?|pip|npm|sudo|cd|ls|cat|chmod|import|package|public|private|static|def|class|return|from|if|for|while|try|except|var|let|const|function)\b.*[\w/;{}():=.-]$"
    r"|[{};]\s*$|^\s*[\w.]+\s*=\s*\S|\b(?:ldap|rmi|jdbc|file|ftp)://|^\s*[$#>]\s+\S+ -|^\s*<\?|::\w|->\w|\w\(\)",
    re.M,
)
_SENTENCE = re.compile(r"[。？！；]|[.?!][\"')）]?(?:\s|$)(?<!\.\s)|[.?!](?=（\d)")
_TOKEN = re.compile(r"[a-z0-9']+|[⺀-鿿]", re.I)
_ITEM = re.compile(r"[\n\t|~★→●…·_,，、;；!?？！。+/]+|  +|\s[-–—]\s|(?<=[⺀-鿿])\s+|\s+(?=[⺀-鿿])")
_LABEL = re.compile(r"^\s*[^：:，,。|#]{1,12}[：:]\s*")

_COUNT = re.compile(r"[（(]\d+[)）]")
_SPACED = re.compile(r"(?:\S {1,2}){8,}\S")

LIST, MACHINE, PROSE, TERMS, SOURCE, STATED = "list", "machine", "prose", "terms", "source", "stated"


@lru_cache(maxsize=8)
def function_share(text: str) -> float:
    """Share of function words among the words; for Chinese, of function characters times two."""
    tokens = _TOKEN.findall(text.lower())
    if not tokens:
        return 0.0
    return (sum(map(FUNCTION_EN.__contains__, tokens)) + 2 * sum(map(FUNCTION_ZH.__contains__, tokens))) / len(tokens)


def close_up(line: str) -> str:
    """A line whose characters stand apart, brought together."""
    if (m := _SPACED.search(line)) and len(m[0]) > 0.6 * len(line):
        return re.sub(r"(?<=\S) {1,2}(?=\S(?: |$))", "", line)
    return line


_LINK, _SITE, _LABELLED, _GOODS = "\ue000", "\ue001", "\ue002", "\ue003"
_SIGNS = _LINK + _SITE + _LABELLED + _GOODS
_TERM = re.compile(rf"[{_SIGNS}]|[a-z0-9']+|[⺀-鿿]", re.I)
_SIGN = re.compile(f"[{_SIGNS}]")


def signed(line: str) -> tuple[str, list[int]]:
    """The line with a sign for each link, host, tag and product number, and the lengths of what they stand for."""
    found: list[int] = []

    def put(sign: str):
        def sub(m: re.Match) -> str:
            if sign == _SITE and _FILE.search(m[0]):
                return m[0]
            found.append(len(m[0]))
            return f" {sign} "

        return sub

    if "://" in line or "www." in line or "WWW." in line:
        line = re.sub(r"<a\s[^>]*?((?:https?://|www\.)[^\s<>\"']+)[^>]*>", r" \1 ", line)
        line = _URL.sub(put(_LINK), line)
        line = _MARKUP.sub(" ", line)
    if "." in line:
        line = _HOST.sub(put(_SITE), line)
    if "#" in line:
        line = _TAG.sub(put(_LABELLED), line)
    if "-" in line:
        line = _PRODUCT.sub(put(_GOODS), line)
    return line, found


@dataclass
class Line:
    """A line with content: its kind so far, its terms as signs and words, and how many characters it has."""

    text: str
    kind: str
    terms: str = ""
    stands: tuple[int, ...] = ()


def read_line(raw: str, fenced: bool) -> Line:
    """The kind that the line's own form tells; TERMS for all that the signals have to judge."""
    line = close_up(raw)
    if fenced:
        return Line(raw, MACHINE)
    if _REFERENCE.match(line):
        return Line(raw, SOURCE, *signed(line))
    terms, stands = signed(line)
    words = _SIGN.sub(" ", terms) if stands else line
    share = function_share(words)
    sentences = bool(_SENTENCE.search(words))
    if stands:
        # Signs amid sentences are prose; beside short words they are terms.
        many = sum(stands) >= 0.6 * len(re.sub(r"\s", "", line)) or len(words) <= 90 * len(stands)
        if many and not re.search(r"[。？！]", words) and share < 0.2 + 0.1 * (sum(stands) >= 0.5 * len(line.strip())):
            return Line(raw, TERMS, terms, tuple(stands))
    if sentences and share >= MOST_FUNCTION and not stands:
        return Line(raw, PROSE)  # no signal holds at such a share
    hits = _MACHINE.findall(words)
    if hits and len(words) / len(hits) < 140:
        return Line(raw, MACHINE, terms, tuple(stands))
    if sentences and share < 0.08 and not re.search(r"[。？]|\.\s", words) and len([x for x in _ITEM.split(words) if x.strip()]) >= 6:
        return Line(raw, TERMS, terms, tuple(stands))  # items parted by marks
    if share < FEW and sentences:
        # Sentences without function words are terms in disguise; the signals will tell.
        return Line(raw, STATED, terms, tuple(stands))
    if sentences:
        return Line(raw, PROSE)
    if _LABEL.match(words):
        items = [x.strip() for x in _ITEM.split(_LABEL.sub("", words)) if x.strip()]
        if len(items) <= 12 and len(set(items)) == len(items):
            return Line(raw, PROSE)  # a label with its few values
    return Line(raw, PROSE if share >= (0.34 if len(words) < 60 else 0.25) else TERMS, terms, tuple(stands))


def sequence(lines: list[Line]) -> tuple[list[str], np.ndarray]:
    """The terms of the lines in order, and the characters that each stands for."""
    terms, size = [], []
    for line in lines:
        stands = iter(line.stands)
        for t in _TERM.findall(line.terms.lower()):
            terms.append(t)
            size.append(next(stands, 1) if t in _SIGNS else len(t))
    return terms, np.array(size, np.float64)


def recurring(terms: list[str], size: np.ndarray, run: int, max_lag: int = MAX_LAG) -> float:
    """The share of the characters in terms that come again, before or after, within ``max_lag`` places: signs by
    themselves, words and characters in runs of ``run``."""
    if len(terms) < 2:
        return 0.0
    _, ids = np.unique(np.array(terms), return_inverse=True)
    marked = np.zeros(len(ids) + 1, np.int32)
    sign = np.array([t in _SIGNS for t in terms])

    def mark(keys: np.ndarray, at: np.ndarray, length: int) -> None:
        order = np.argsort(keys, kind="stable")
        same = np.diff(keys[order]) == 0
        gaps = np.diff(at[order])
        near = same & (gaps <= max_lag)
        for side in (at[order][1:][near], at[order][:-1][near]):
            np.add.at(marked, side, 1)
            np.add.at(marked, side + length, -1)

    if sign.any():
        mark(ids[sign], np.flatnonzero(sign), 1)
    if len(ids) >= 2 * run:
        grams = np.lib.stride_tricks.sliding_window_view(ids, run)
        _, gram_ids = np.unique(grams, axis=0, return_inverse=True)
        mark(gram_ids.ravel(), np.arange(len(gram_ids)), run)
    return float(size[np.cumsum(marked)[:-1] > 0].sum() / size.sum())


def evenness(terms: list[str], max_lag: int = MAX_LAG) -> float:
    """The highest autocorrelation of the sequence over the lags: the share of places with the same term as
    the place a lag before."""
    if len(terms) < 4:
        return 0.0
    _, ids = np.unique(np.array(terms), return_inverse=True)
    return max(float((ids[k:] == ids[:-k]).mean()) for k in range(1, min(max_lag, len(ids) // 2) + 1))


#: Share of function words under which a sentence is none, and the shares from which the signals hold.
FEW = 0.16
#: Share of function words from which no signal holds, whatever the block.
MOST_FUNCTION = 0.34
GAPS, GAPS_STATED, LAGS = 0.5, 0.6, 0.15


def holds(lines: list[Line], stated: bool = False) -> bool:
    """Whether the signals hold the lines for a list."""
    block = "\n".join(x.terms for x in lines)
    plain = _SIGN.sub(" ", block) if any(x.stands for x in lines) else block
    terms, size = sequence(lines)
    if not terms:
        return False
    share = function_share(plain)
    chinese = sum(t >= "⺀" and t not in _SIGNS for t in terms) * 2 > len(terms)
    signs = float(size[[t in _SIGNS for t in terms]].sum() / size.sum())
    # Signs carry no function words: the more of them, the more words of any kind may stand between.
    few = (0.08 if chinese else FEW) if stated else MOST_FUNCTION if signs > 0.3 else 0.2
    if share >= few:
        return False
    if "gaps" in SIGNALS and (len(terms) >= 16 or signs > 0.3) and recurring(terms, size, RUN_CHARS if chinese else RUN_WORDS) >= (GAPS_STATED if stated else GAPS):
        return True
    if stated:
        return False
    items = [x.strip() for x in _ITEM.split(_COUNT.sub("", block)) if x.strip()]
    short = sum(len(x) <= (12 if x[-1] >= "⺀" else 40) for x in items) / max(1, len(items))
    if "lags" in SIGNALS and short >= 0.7 and len(items) >= 4 and evenness(terms) >= LAGS:
        return True
    # all different: many short noun items without function words
    return "nouns" in SIGNALS and len(items) >= 6 and short >= 0.9 and share < 0.1


def kinds(text: str) -> list[tuple[str, str]]:
    """(kind, line) for the lines with content; term lines end up as list, machine or prose."""
    lines: list[Line] = []
    fenced = False
    for raw in text.split("\n"):
        if not raw.strip():
            continue
        if raw.lstrip().startswith("```"):
            fenced = not fenced
            lines.append(Line(raw, MACHINE))
        else:
            lines.append(read_line(raw, fenced))
    for x in lines:
        if x.kind == STATED:
            x.kind = LIST if holds([x], stated=True) else PROSE
    # Sources beneath prose are what they are; sources alone are links to be judged.
    prose = False
    for x in lines:
        prose = prose or x.kind == PROSE
        if x.kind == SOURCE and not prose:
            x.kind = TERMS
    at, unsure = 0, []
    while at < len(lines):
        if lines[at].kind != TERMS:
            at += 1
            continue
        end = at
        while end < len(lines) and lines[end].kind == TERMS:
            end += 1
        region = lines[at:end]
        near = [x.kind for x in lines[max(0, at - AROUND) : at] + lines[end : end + AROUND]]
        machine = near.count(MACHINE) * 2 > len(near)
        if holds(region):
            # bare status lines in the midst of machine output
            few = machine and not any(x.stands for x in region) and sum(len(x.terms) for x in region) < 60 and len(region) < 4
            kind = MACHINE if few else LIST
        else:
            kind = MACHINE if machine else PROSE
            unsure.append((at, end))
        for x in region:
            x.kind = kind
        at = end
    # Blocks too small to judge alone are judged as one sequence.
    loose = [(a, b) for a, b in unsure if lines[a].kind != MACHINE]
    if len(loose) > 1 and any(x.stands for a, b in loose for x in lines[a:b]):
        together = [x for a, b in loose for x in lines[a:b]]
        if holds(together):
            for x in together:
                x.kind = LIST
            unsure = [x for x in unsure if x not in loose]
    # A block too small to judge goes with the lists around it, if it has as few function words.
    for at, end in unsure:
        near = [x.kind for x in lines[max(0, at - AROUND) : at] + lines[end : end + AROUND]]
        block = "\n".join(x.terms for x in lines[at:end])
        if near and near.count(LIST) * 2 >= len(near) and function_share(_SIGN.sub(" ", block)) < 0.3 and not _SENTENCE.search(block):
            for x in lines[at:end]:
                x.kind = LIST
    return [(x.kind, x.text) for x in lines]


def stuffed_share(text: str) -> float:
    """Share of the characters, blanks apart, that lie in lists of keywords, links, hosts, tags or products."""
    total = listed = 0
    for kind, line in kinds(text):
        n = len(line.strip())
        total += n
        listed += n * (kind == LIST)
    return listed / total if total else 0.0


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc, text)."""
    for batch in batches:
        shares = [stuffed_share(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["doc", "share"])


def stuffed_shares(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stuffed_share) for every row."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    judged = rows.mapInArrow(judge, f"doc {dict(rows.dtypes)['doc']}, share double")
    return judged.select(F.col("doc").alias(doc_id), F.col("share").alias("stuffed_share"))


def stuffed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    return stuffed_shares(docs, doc_id, text).where(F.col("stuffed_share") > share).select(doc_id)
