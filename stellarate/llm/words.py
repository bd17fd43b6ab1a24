"""Words of all texts of a batch at once, as places and hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from stellarate.llm.suffixes import BASES, mixed, powers

#: Bytes looked at together; longer only where a single word is longer.
SECTION = 1 << 20
#: Powers of the base; places in longer words repeat them.
REACH = 1 << 16

POWERS = powers(BASES[0], REACH)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A boolean per byte: True in one of the ranges, ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes between words: white space, or all ASCII but digits and lower-case letters.
WHITE = table((0x20, 0x20), (0x09, 0x0D))
NOT_ALPHANUMERIC = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def _sections(data: np.ndarray, between: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of ``data`` at document starts or between words, about ``SECTION`` bytes apart."""
    at, end = 0, len(data)
    while at < end:
        stop = at + SECTION
        if stop >= end:
            yield at, end
            return
        doc = offsets[np.searchsorted(offsets, stop, "right") - 1]
        if doc > at:
            stop = int(doc)
        else:
            limit = int(offsets[np.searchsorted(offsets, stop, "right")])
            step = 1 << 12
            while stop < limit:
                gap = np.flatnonzero(between[data[stop : min(stop + step, limit)]])
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(stop + step, limit)
                step *= 2
        yield at, stop
        at = stop


class Words:
    """``starts``, ``ends`` (bytes of the batch), ``hashes`` and ``doc`` of each word in order.

    ``first[i] : first[i + 1]`` are the words of document i. Bytes are compared after
    ``LOWER`` where ``lower`` is set.
    """

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray, lower: bool
    ) -> None:
        starts, ends, hashes = [], [], []
        heads = offsets[:-1][np.diff(offsets) > 0]
        for a, b in _sections(data, between, offsets):
            part = data[a:b]
            if lower:
                part = LOWER[part]
            inside = ~between[part]
            begin, close = inside.copy(), inside.copy()
            begin[1:] &= ~inside[:-1]
            close[:-1] &= ~inside[1:]
            own = heads[np.searchsorted(heads, a) : np.searchsorted(heads, b)] - a
            begin[own] = inside[own]
            own = own[own > 0] - 1
            close[own] = inside[own]
            start = np.flatnonzero(begin)
            if not len(start):
                continue
            end = np.flatnonzero(close) + 1
            length = end - start
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            weighed = part[inside] * POWERS[place & (REACH - 1)]
            sums = np.add.reduceat(weighed, np.cumsum(length) - length)
            starts.append(start + a)
            ends.append(end + a)
            hashes.append(mixed(sums ^ mixed(length.astype(np.uint64))))
        none = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.hashes = np.concatenate(hashes) if hashes else none.astype(np.uint64)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)


def word_hash(word: bytes) -> int:
    """The hash that ``Words`` gives a word."""
    data = np.frombuffer(word, np.uint8)
    sums = (data * POWERS[np.arange(len(data)) & (REACH - 1)]).sum(dtype=np.uint64)
    length = np.array([len(data)], np.uint64)
    return int(mixed(np.array([sums]) ^ mixed(length))[0])


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, from the words' hashes."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for step, weight in enumerate(powers(BASES[1], size)):
        out += hashes[step : step + count] * weight
    return mixed(out)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each shingle; a shorter text with words is one shingle."""
    every = shingle_hashes(words.hashes, size)
    if len(every):
        inside = words.doc[: len(every)] == words.doc[size - 1 :]
        every, doc = every[inside], words.doc[: len(inside)][inside]
    else:
        doc = np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        own = [
            shingle_hashes(words.hashes[words.first[d] : words.first[d + 1]], int(words.counts[d]))
            for d in short
        ]
        every, doc = np.concatenate([every, *own]), np.concatenate([doc, short])
    return every, doc


def text_shingles(text: str | None, size: int) -> list[bytes]:
    """The distinct shingles of one text itself, in order; its words are lower-cased (A-Z)."""
    words = (text or "").encode().lower().split()
    span = min(size, len(words))
    found = [b" ".join(words[i : i + span]) for i in range(len(words) - span + 1) if span]
    return list(dict.fromkeys(found))
