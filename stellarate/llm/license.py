"""Licence scans: base phrases, and an exact set-similarity join with licence templates.

A text block matches a template if it has at least ``CONTAINMENT`` of the template's
distinct words. The join orders all template words by their number in the whole
corpus, rarest first, and for a template of m words of which o must be there:

* prefix filter: a match has one of the template's first m - o + 1 words, so only
  blocks that hold such a word are looked at;
* length filter: a match has at least o words;
* positional filter: where a block's first common word is the template's word i and
  the block's template word j, at most 1 + min(words behind i, words behind j) can be
  common, which must reach o.

What passes is verified on the word sets. Short notices are matched with lines, whole
licence passages with paragraphs (lines up to a blank one).
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Batches, map_arrow, sliced, text_buffer
from stellarate.llm.words import LOWER, NOT_ALPHANUMERIC, WHITE, Words, word_hash

CONTAINMENT = 0.9

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: One-line notices, by label.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("bsd-3", "licensed under the bsd 3 clause license"),
    ("isc", "licensed under the isc license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0"),
)

#: Passages of licence texts, by label.
PASSAGES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
    ),
    (
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
    ),
)


def needed(count: int) -> int:
    return max(1, math.ceil(round(CONTAINMENT * count, 9)))


def vocabulary() -> list[str]:
    return sorted({w for _, text in (*NOTICES, *PASSAGES) for w in text.split()})


class Template:
    def __init__(self, label: str, text: str, rank: dict[str, int]) -> None:
        self.label = label
        self.words = sorted({rank[w] for w in text.split()})
        self.needed = needed(len(self.words))
        self.prefix = self.words[: len(self.words) - self.needed + 1]


class Join:
    """Blocks, given by their template words, to the templates that they contain."""

    def __init__(self, templates: tuple, rank: dict[str, int]) -> None:
        self.templates = [Template(label, text, rank) for label, text in templates]
        self.by_prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, template in enumerate(self.templates):
            for place, word in enumerate(template.prefix):
                self.by_prefix[word].append((number, place))
        self.starts = np.array(sorted(self.by_prefix), np.int64)

    def matches(self, block: list[int], size: int) -> list[tuple[str, float]]:
        """``block``: its template words by rank, ``size``: its words in all."""
        found, seen = [], set()
        for place, word in enumerate(block):
            for number, at in self.by_prefix.get(word, ()):
                if number in seen:
                    continue
                seen.add(number)
                template = self.templates[number]
                rest = min(len(template.words) - at, len(block) - place)
                if size < template.needed or rest < template.needed:
                    continue
                common = len(set(template.words).intersection(block))
                if common >= template.needed:
                    found.append((template.label, common / len(template.words)))
        return found


def template_words(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are in a template, and which of the sorted ``hashes`` they are."""
    seen = np.zeros(1 << 16, bool)
    seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
    some = np.flatnonzero(seen[(words.hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(hashes, words.hashes[some]), len(hashes) - 1)
    hit = hashes[at] == words.hashes[some]
    return some[hit], at[hit]


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of some words, and the order that sorts them."""
    h = np.array([word_hash(w.encode()) for w in words], np.uint64)
    order = np.argsort(h)
    return h[order], order


def count_words(batches: Batches) -> Batches:
    """(place in the vocabulary, occurrences) of a task's documents."""
    hashes, order = hashed(vocabulary())
    counts = np.zeros(len(order), np.int64)
    for rows in sliced(batches, 0):
        data, offsets = text_buffer(rows.column(0))
        _, at = template_words(Words(data, offsets, NOT_ALPHANUMERIC, lower=True), hashes)
        counts += np.bincount(order[at], minlength=len(order))
    place = np.arange(len(counts), dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts)], names=["word", "n"])


def ranks(docs: DataFrame) -> dict[str, int]:
    """Template words by their number in all of ``docs``, rarest first."""
    counts = map_arrow(docs.select("text"), count_words, "word int, n long")
    found = dict(counts.groupBy("word").agg(F.sum("n")).collect())
    words = vocabulary()
    order = sorted(range(len(words)), key=lambda i: (found.get(i, 0), words[i]))
    return {words[i]: rank for rank, i in enumerate(order)}


def line_numbers(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the line and of the paragraph that each byte of ``places`` is in."""
    ends = np.flatnonzero(data == 10)
    inner = np.append(0, np.cumsum(~WHITE[data], dtype=np.int64))
    # a paragraph ends at a line without anything but white space
    blank = np.zeros(len(ends), np.int64)
    blank[1:] = inner[ends[1:]] == inner[ends[:-1]]
    line = np.searchsorted(ends, places)
    return line, np.append(0, np.cumsum(blank))[line]


class Scan:
    NAMES = "doc_id n_words n_base first_word last_word base_labels labels score".split()

    def __init__(self, rank: dict[str, int]) -> None:
        self.rank = rank

    def phrases(self, words: Words) -> list[tuple[str, np.ndarray]]:
        """Label and places of each base phrase."""
        out = []
        for phrase, label in PHRASES.items():
            own = [np.uint64(word_hash(w.encode())) for w in phrase.split()]
            count = max(0, len(words.hashes) - len(own) + 1)
            at = np.flatnonzero(words.hashes[:count] == own[0])
            for step, h in enumerate(own[1:], 1):
                at = at[words.hashes[at + step] == h]
            out.append((label, at[words.doc[at] == words.doc[at + len(own) - 1]]))
        return out

    def __call__(self, batches: Batches) -> Batches:
        by_rank = sorted(self.rank, key=self.rank.get)
        hashes, order = hashed(by_rank)
        joins = [Join(NOTICES, self.rank), Join(PASSAGES, self.rank)]
        for rows in sliced(batches, 1):
            data, offsets = text_buffer(rows.column(1))
            words = Words(data, offsets, NOT_ALPHANUMERIC, lower=True)
            texts = len(words.counts)
            n_base = np.zeros(texts, np.int64)
            first = np.full(texts, np.iinfo(np.int64).max)
            last = np.full(texts, -1)
            base, labels = defaultdict(set), defaultdict(set)
            score = np.zeros(texts)
            for label, at in self.phrases(words):
                doc = words.doc[at]
                n_base += np.bincount(doc, minlength=texts)
                np.minimum.at(first, doc, at - words.first[doc])
                np.maximum.at(last, doc, at - words.first[doc])
                score[doc] = 1.0
                for d in doc.tolist():
                    base[d].add(label)
            place, at = template_words(words, hashes)
            word, doc = order[at], words.doc[place]
            for join, block in zip(joins, line_numbers(data, words.starts)):
                self.match(join, words, block, place, word, doc, labels, score)
            out = [
                words.counts,
                n_base,
                pa.array(np.where(n_base > 0, first, 0), mask=n_base == 0),
                pa.array(np.where(n_base > 0, last, 0), mask=n_base == 0),
                [",".join(sorted(base[d])) if d in base else "" for d in range(texts)],
                [",".join(sorted(base.get(d, set()) | labels.get(d, set()))) for d in range(texts)],
                score,
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(c if isinstance(c, pa.Array) else pa.array(c) for c in out)],
                names=self.NAMES,
            )

    def match(self, join, words, block, place, word, doc, labels, score) -> None:
        """Adds what one join finds. Lines of different texts can have one number, so a
        block is a text and a number."""
        own = block[place]
        start = np.isin(word, join.starts)
        # prefix filter: blocks with a prefix word of some template
        key = doc * (int(block[-1]) + 2 if len(block) else 1) + own
        some = np.isin(key, np.unique(key[start]))
        key, word, doc, own = key[some], word[some], doc[some], own[some]
        order = np.lexsort((word, key))
        key, word, doc, own = key[order], word[order], doc[order], own[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
        for a, b in zip(begin, [*begin[1:], len(key)]):
            d = int(doc[a])
            lines = block[words.first[d] : words.first[d + 1]]
            size = np.searchsorted(lines, own[a], "right") - np.searchsorted(lines, own[a])
            for label, common in join.matches(list(dict.fromkeys(word[a:b].tolist())), int(size)):
                labels[d].add(label)
                score[d] = max(score[d], common)


def scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its phrases, labels and score.

    Words are runs of letters, digits and non-ASCII characters of the text with A-Z
    lower-cased. ``score`` is 1 with a base phrase, else the largest containment of a
    matched template, else 0. Null texts are empty, without words and labels (empty
    strings); repeated rows are scanned each; other columns are not looked at.
    """
    return map_arrow(
        docs.select("doc_id", "text"),
        Scan(ranks(docs)),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )
