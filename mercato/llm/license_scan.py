"""Operator 6, license scans by an exact set-similarity join.

Documents are read as words; a block is a run of ``block_words`` words (of
twice a template's words, where that is more) and starts at any word. It
matches a template where it holds at least ``threshold`` of the template's
distinct words. The join is exact. Tokens have one global order, by the
number of documents that have them (counted over the whole corpus for the
templates' own words, a set whose size the templates bound; a block's other
words come before them), rarest first. A template of n words that must share
``need = ceil(threshold * n)`` has a prefix of ``n - need + 1`` words, and a
block that matches holds one of them (prefix filter). So only the stretches
around the places of prefix words are looked at: all blocks that hold such a
place lie in it. A stretch of fewer words than ``need`` is passed over (length
filter), and so is one with fewer than ``need`` distinct words from the prefix
word on in the order (positional filter). In what is left a block slides from
one of the template's words to the next and its distinct words are counted.

Phrases are templates whose threshold is 1 and whose words must also stand
consecutively: their rarest word finds the places, their neighbours verify
them. Every place counts.

Cases: a null text counts as empty; an empty text has no words, no labels
and score 0; a text of any length is read block by block; repeated rows are
scanned alike; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The phrases and labels of the query's contract.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Notices and texts of well-known public licenses, by label.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "apache": "licensed under the apache license version 2.0",
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met",
            "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met 1 redistributions of source code must retain the above copyright "
            "notice this list of conditions and the following disclaimer 2 redistributions in binary form must "
            "reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution this software is provided by the "
            "copyright holders and contributors as is and any express or implied warranties including but not "
            "limited to the implied warranties of merchantability and fitness for a particular purpose are "
            "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
            "incidental special exemplary or consequential damages including but not limited to procurement of "
            "substitute goods or services loss of use data or profits or business interruption however caused and "
            "on any theory of liability whether in contract strict liability or tort including negligence or "
            "otherwise arising in any way out of the use of this software even if advised of the possibility of "
            "such damage"),
    "cc-by": "licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted",
            "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all "
            "copies the software is provided as is and the author disclaims all warranties with regard to this "
            "software including all implied warranties of merchantability and fitness in no event shall the author "
            "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
            "from loss of use data or profits whether in an action of contract negligence or other tortious action "
            "arising out of or in connection with the use or performance of this software"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software and to permit persons to whom the software is furnished to do so subject to "
            "the following conditions the above copyright notice and this permission notice shall be included in "
            "all copies or substantial portions of the software the software is provided as is without warranty of "
            "any kind express or implied including but not limited to the warranties of merchantability fitness "
            "for a particular purpose and noninfringement in no event shall the authors or copyright holders be "
            "liable for any claim damages or other liability whether in an action of contract tort or otherwise "
            "arising from out of or in connection with the software or the use or other dealings in the software"),
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "proprietary": "all rights reserved",
}
THRESHOLD, BLOCK_WORDS = 0.8, 64
# A word: letters and digits after lower-casing A-Z, and anything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


SEGMENT = 1 << 22  # bytes of a text whose words are held at once


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def labelled(templates: dict[str, str | tuple[str, ...]]) -> list[tuple[str, str]]:
    """(label, text) of every template; a label may have several texts."""
    return [(label, text) for label, texts in sorted(templates.items())
            for text in ((texts,) if isinstance(texts, str) else texts)]


def word_segments(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    data = (text or "").encode().lower()
    start = 0
    while start < len(data):
        end = start + SEGMENT
        while end < len(data) and _WORD.match(data, end):
            end += 1
        yield _WORD.findall(data, start, end)
        start = end


class Scanner:
    """Templates and phrases with their prefixes under one token order."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]], phrases: dict[str, str], threshold: float,
                 block_words: int, frequency: dict[bytes, int]):
        rank = lambda w: (frequency.get(w, 0), w)
        vocabulary = {w for _, t in labelled(templates) for w in words_of(t)}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=rank))}
        self.phrases = []
        self.by_word: dict[bytes, list[int]] = {}  # prefix word: its templates
        self.templates = []
        for phrase, label in phrases.items():
            words = words_of(phrase)
            rarest = min(range(len(words)), key=lambda i: rank(words[i]))
            self.phrases.append((words, label, rarest))
        for label, text in labelled(templates):
            words = words_of(text)
            order = sorted(set(words), key=self.rank.__getitem__)
            if not order:
                continue  # a template without words matches nothing
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            for w in order[:len(order) - need + 1]:
                self.by_word.setdefault(w, []).append(len(self.templates))
            self.templates.append((label, order, need, max(block_words, 2 * len(words))))
        self.triggers = frozenset(self.by_word) | {p[0][p[2]] for p in self.phrases}
        self.overlap = max([1, *(t[3] for t in self.templates), *(len(p[0]) for p in self.phrases)])

    def scan_text(self, text: str | None) -> tuple:
        """n_words, then what ``scan`` finds in the whole text: parts overlap
        by the longest block or phrase."""
        held, begins, found = [], 0, []
        for words in word_segments(text):
            held += words
            limit = len(held) - self.overlap
            if len(held) * 8 > SEGMENT and limit > 0:
                found.append((begins, self.scan(held, limit)))
                held, begins = held[limit:], begins + limit
        found.append((begins, self.scan(held)))
        if len(found) == 1:
            return (begins + len(held), *found[0][1])
        firsts = [b + f[1] for b, f in found if f[1] is not None]
        lasts = [b + f[2] for b, f in found if f[2] is not None]
        joined = [",".join(sorted({x for _, f in found for x in f[k].split(",") if x})) for k in (3, 4)]
        return (begins + len(held), sum(f[0] for _, f in found), min(firsts, default=None), max(lasts, default=None),
                *joined, max(f[5] for _, f in found))

    def scan(self, words: list[bytes], limit: int | None = None) -> tuple:
        """n_base, first_word, last_word, base_labels, labels, score; with
        ``limit`` only of phrases that start before it (blocks in the overlap
        of two parts are met twice, which changes nothing)."""
        if self.triggers.isdisjoint(words):
            return 0, None, None, "", "", 0.0
        end = len(words) if limit is None else limit
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.triggers or w in self.rank:
                at.setdefault(w, []).append(i)
        n_base, first, last, base = 0, None, None, set()
        for phrase, label, rarest in self.phrases:
            for i in at.get(phrase[rarest], ()):
                start = i - rarest
                if 0 <= start < end and words[start:start + len(phrase)] == phrase:
                    n_base += 1
                    base.add(label)
                    first = start if first is None else min(first, start)
                    last = start if last is None else max(last, start)
        labels, score = set(base), 1.0 if base else 0.0
        for t in sorted({t for w in at.keys() & self.by_word.keys() for t in self.by_word[w]}):
            label, tokens, need, _ = self.templates[t]
            shared = self.most_shared(at, t, len(words))
            if shared >= need:
                labels.add(label)
                score = max(score, shared / len(tokens))
        return n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score

    def most_shared(self, at: dict[bytes, list[int]], t: int, n_words: int) -> int:
        """The most distinct words of template ``t`` in one block, of the
        blocks that can hold as many as it needs (0 if there is none)."""
        _, order, need, block = self.templates[t]
        if n_words < need or sum(w in at for w in order) < need:
            return 0
        hits = sorted((i, k) for k, w in enumerate(order) for i in at.get(w, ()))
        places = [i for i, _ in hits]
        best, done = 0, 0  # hits before `done` have been the last of a block
        for i, k in hits:
            if k > len(order) - need:
                continue  # not a prefix word
            low, high = bisect_left(places, i - block + 1), bisect_left(places, i + block)
            # blocks whose rarest word of the template is this one: at most its words from place k on
            if high - low < need or high <= done or len({m for _, m in hits[low:high] if m >= k}) < need:
                continue
            best = max(best, self.slide(hits, max(low, bisect_left(places, places[done] - block + 1) if done else 0), high, block))
            done = high
        return best

    @staticmethod
    def slide(hits: list[tuple[int, int]], low: int, high: int, block: int) -> int:
        """The most distinct words among ``hits[low:high]`` that lie in one block."""
        held: Counter = Counter()
        first, best = low, 0
        for i, k in hits[low:high]:
            held[k] += 1
            while hits[first][0] <= i - block:
                left = hits[first][1]
                held[left] -= 1
                if not held[left]:
                    del held[left]
                first += 1
            best = max(best, len(held))
        return best


def token_frequency(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of a few tokens is, over all documents."""
    wanted = frozenset(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                own: set[bytes] = set()
                for words in word_segments(text.as_py()):
                    own.update(wanted.intersection(words))
                seen.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         ["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in rows.collect()}  # one row per template word


SCAN = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double")


def scan_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] = TEMPLATES,
                  phrases: dict[str, str] = PHRASES,
                  threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document with the columns of ``SCAN``."""
    tokens = {w for t in [*(t for _, t in labelled(templates)), *phrases] for w in words_of(t)}
    scanner = Scanner(templates, phrases, threshold, block_words, token_frequency(docs, tokens))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = [c.split()[0] for c in SCAN.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan_text(text.as_py()) for text in batch.column(1)]
            cols = [pa.array(c, t) for c, t in zip(zip(*found), kinds)] if found else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCAN)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL: dict[str, str] = {}
