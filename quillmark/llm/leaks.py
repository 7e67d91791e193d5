"""Evaluation passages inside training documents: one Aho-Corasick automaton over all passages.

A passage's runs of ``words_en`` words or ``chars_zh`` characters are the automaton's patterns, so that a
match is a run of that length and nothing shorter counts.  Texts are read once as a stream of letters,
digits and Chinese characters in lower case and plain width; each kept character remembers its place in
the original, so that the spans reported are the original's.  A run of words must begin and end at a word's
edge.

The items are collected to build the automaton; their number is checked against ``max_items`` (the tables
of test items are fixed and small).  More items than that are scanned in blocks of ``max_items``, one
automaton each, over the same texts: slower but whole.

Cases: a null or empty text leaks nothing; a passage shorter than a run gives no pattern; items with the
same passage are all reported; repeated documents each count under their own id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_EN = 12
CHARS_ZH = 24
MAX_ITEMS = 2000

_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_WORD = re.compile(r"[^\W_]+")
#: Characters that show nothing: they neither are nor end a word.
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")


def fold(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The kept characters in lower case and plain width, the place of each in ``text``, and whether each
    follows the one before without anything visible between."""
    seen = np.fromiter((i for i, c in enumerate(text) if not _UNSEEN.match(c)), np.int32) if _UNSEEN.search(text) else None
    low = (text if seen is None else "".join(text[i] for i in seen)).translate(_WIDTH)
    low = low.lower() if len(low.lower()) == len(low) else "".join(c.lower()[:1] for c in low)
    spans = [m.span() for m in _WORD.finditer(low)]
    at = np.concatenate([np.arange(*x, dtype=np.int32) for x in spans]) if spans else np.empty(0, np.int32)
    joined = np.diff(at, prepend=-2) == 1
    return "".join(low[i:j] for i, j in spans), at if seen is None else seen[at], joined


def flat_text(text: str) -> str:
    """The kept characters alone: quicker than :func:`fold`, enough to see that nothing matches."""
    low = _UNSEEN.sub("", text).translate(_WIDTH)
    low = low.lower() if len(low.lower()) == len(low) else "".join(c.lower()[:1] for c in low)
    return "".join(_WORD.findall(low))


def runs(passage: str, lang: str, words_en: int = WORDS_EN, chars_zh: int = CHARS_ZH) -> set[str]:
    low = _UNSEEN.sub("", passage).translate(_WIDTH).lower()
    words = _WORD.findall(low)
    if lang == "en":
        return {"".join(words[i : i + words_en]) for i in range(len(words) - words_en + 1)}
    flat = "".join(words)
    return {flat[i : i + chars_zh] for i in range(len(flat) - chars_zh + 1)}


_BUILT: dict[int, ahocorasick.Automaton] = {}


def automaton(items: list[tuple[int, str, str]], words_en: int, chars_zh: int) -> ahocorasick.Automaton:
    """Pattern -> (length, whether of words, item numbers); kept for the next batch of the same worker."""
    key = hash((tuple(items), words_en, chars_zh))
    if key not in _BUILT:
        who: dict[str, tuple[bool, set[int]]] = {}
        for ident, lang, passage in items:
            for run in runs(passage, lang, words_en, chars_zh):
                who.setdefault(run, (lang == "en", set()))[1].add(ident)
        built = ahocorasick.Automaton()
        for run, (of_words, ids) in who.items():
            built.add_word(run, (len(run), of_words, tuple(sorted(ids))))
        if who:
            built.make_automaton()
        _BUILT.clear()
        _BUILT[key] = built
    return _BUILT[key]


def _latin(c: str) -> bool:
    return c.isalnum() and not "⺀" <= c <= "鿿"


def leaks_in(text: str, built: ahocorasick.Automaton) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) in the original's characters, one for each stretch of overlapping runs."""
    if not len(built):
        return
    met = list(built.iter(flat_text(text)))
    if not met:
        return
    flat, at, joined = fold(text)
    open_spans: dict[int, list[int]] = {}
    for last, (length, of_words, ids) in met:
        first = last - length + 1
        start, end = int(at[first]), int(at[last]) + 1
        if of_words:
            inside = first > 0 and joined[first] and _latin(flat[first - 1])
            beyond = last + 1 < len(flat) and joined[last + 1] and _latin(flat[last + 1])
            if inside or beyond:
                continue
        for ident in ids:
            span = open_spans.get(ident)
            if span and start <= span[1]:
                span[1] = max(span[1], end)
            else:
                if span:
                    yield ident, *span
                open_spans[ident] = [start, end]
    for ident, span in open_spans.items():
        yield ident, *span


def scanner(items: list[tuple[int, str, str]], words_en: int, chars_zh: int):
    """For mapInArrow over (doc, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton(items, words_en, chars_zh)
        for batch in batches:
            docs, rows = batch.column(0), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                rows += [(k, *x) for x in leaks_in(text or "", built)]
            where = pa.array([r[0] for r in rows], pa.int32())
            cols = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()))]
            yield pa.RecordBatch.from_arrays([docs.take(where), *cols], names=["doc", "item", "start", "end"])

    return scan


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    lang: str = "lang",
    words_en: int = WORDS_EN,
    chars_zh: int = CHARS_ZH,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, start, end): each stretch of a document that repeats runs of an item's passage."""
    kept = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull())
    kept = kept.select(F.col(item_id).cast("long"), F.coalesce(F.col(lang), F.lit("zh")), F.col(passage)).distinct()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    schema = f"doc {dict(rows.dtypes)['doc']}, item long, start int, end int"
    found, after = None, None
    while True:
        block = (kept if after is None else kept.where(F.col(item_id) > after)).orderBy(item_id).limit(max_items).collect()
        if not block and found is not None:
            break
        one = rows.mapInArrow(scanner(sorted(map(tuple, block)), words_en, chars_zh), schema)
        found = one if found is None else found.union(one)
        if len(block) < max_items:
            break
        after = block[-1][0]
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "start", "end")


def leaking_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaked_passages(docs, items).select("doc_id", "item_id").distinct()
