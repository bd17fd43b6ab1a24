"""Token ids of whole texts, with words that were seen before looked up instead of encoded.

The word tokenizer drops white space and never joins what stands on either side of
it, so the ids of a text are those of its space-separated words in turn. A word of
Latin letters that ends in punctuation is its lower-cased letters and its
punctuation. Everything else goes to the tokenizer as it stands.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stellarate.llm.cluster import caches

#: Parts of words that are kept; further ones are encoded once per batch and forgotten.
MOST_PARTS = 300_000
#: Characters looked at together.
CHARACTERS = 1 << 21

#: Parts encoded as one text, and how this tokenizer writes the end of a word.
JOINED = 100
WORD_END = "</w>"
WORD = re.compile("[a-zß-öø-ÿ]+")

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = rf"^(?P<letters>[{LETTERS}]+)(?P<mark>[!-&(-/:-@\[-`{{-~]*)$"


def gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``start``, one after the other."""
    begin = np.cumsum(length) - length
    return ids[np.repeat(start - begin, length) + np.arange(length.sum())]


class WordEncoder:
    """Encodes with the tokenizer file at ``path``; ids come as little-endian 32-bit numbers.

    The ids of all parts stand in one array; a part is known by its number, and ``start`` and
    ``length`` say where its ids are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.number: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, "<u4")
        self.start = np.zeros(1, np.int64)
        self.length = np.zeros(1, np.int64)

    def encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, how many each has).

        Parts of letters are encoded many at a time, as words of one text. Each ends with an
        id that stands for the end of a word; should there be another number of those than of
        parts, every part is encoded by itself.
        """
        text = [" ".join(parts[at : at + JOINED]) for at in range(0, len(parts), JOINED)]
        found = self.tokenizer.encode_batch_fast(text, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable([e.ids for e in found]), "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(parts) and (not len(ids) or ends[-1:] == len(ids)):
            return ids, np.diff(np.append(0, ends))
        return self.encoded_alone(parts)

    def encoded_alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        lists = [e.ids for e in found]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), "<u4", length.sum()), length

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part; new ones are encoded and added to the arrays."""
        found = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        places = np.flatnonzero(found < 0)
        if len(places):
            new = [parts[i] for i in places.tolist()]
            words = [bool(WORD.fullmatch(part)) for part in new]
            new = [*compress(new, words), *(p for p, word in zip(new, words) if not word)]
            whole = sum(words)
            ids, length = self.encoded(new[:whole])
            more, rest = self.encoded_alone(new[whole:])
            length = np.concatenate([length, rest])
            first = len(self.length)
            self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.ids = np.concatenate([self.ids, ids, more])
            word = np.array(words)
            found[places[word]] = first + np.arange(whole)
            found[places[~word]] = first + whole + np.arange(len(new) - whole)
            if first + len(new) <= MOST_PARTS:
                self.number.update(zip(new, range(first, first + len(new))))
        return found

    def forget(self) -> None:
        """Drop the ids of parts that are not kept."""
        kept = len(self.number)
        if len(self.length) > kept:
            end = int(self.start[kept])
            self.start, self.length = self.start[:kept].copy(), self.length[:kept].copy()
            self.ids = self.ids[:end].copy()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        split = pc.extract_regex(words, PLAIN)
        plain = split.is_valid()
        letters = pc.utf8_lower(pc.struct_field(split, "letters"))
        heads = pc.if_else(plain, letters, words).dictionary_encode()
        none = pa.scalar("", words.type)
        marks = pc.if_else(plain, pc.struct_field(split, "mark"), none).dictionary_encode()
        parts = np.empty((len(words), 2), np.int64)
        for place, column in enumerate((heads, marks)):
            numbers = self.numbers(column.dictionary.to_pylist())
            parts[:, place] = numbers[column.indices.to_numpy()]
        length = self.length[parts]
        ids = gathered(self.ids, self.start[parts].ravel(), length.ravel())
        self.forget()
        return ids, length.sum(axis=1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for place, text in enumerate(texts):
            for part in stretches(text):
                if size + len(part) > CHARACTERS and held:
                    self.look_up(held, out)
                    held, size = [], 0
                held.append((place, part))
                size += len(part)
        if held:
            self.look_up(held, out)
        return [ids[0] if len(ids) == 1 else b"".join(ids) for ids in out]

    def look_up(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Finds the distinct words of some texts, and puts their ids in the texts' order."""
        texts = pa.array([part for _, part in held], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        # what is made here has no cycles, and the collector would walk all kept parts
        collecting = gc.isenabled()
        gc.disable()
        try:
            blob, sizes = self.words(coded.dictionary)
        finally:
            if collecting:
                gc.enable()
        index = coded.indices.to_numpy()
        count = sizes[index]
        ids = gathered(blob, (np.cumsum(sizes) - sizes)[index], count)
        ends = np.append(0, np.cumsum(count))[split.offsets.to_numpy()].tolist()
        for (place, _), a, b in zip(held, ends[:-1], ends[1:]):
            out[place].append(ids[a:b].tobytes())


def stretches(text: str) -> Iterator[str]:
    """``text`` cut at spaces to stretches of about ``CHARACTERS`` characters."""
    at = 0
    while len(text) - at > 2 * CHARACTERS:
        end = text.find(" ", at + CHARACTERS)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def encoder(path: str) -> WordEncoder:
    """The encoder of a worker process; it stays until a task comes that needs none."""
    if path not in caches:
        caches[path] = WordEncoder(path)
    return caches[path]


def encode_column(path: str, column: pa.Array, end_id: int) -> Iterator[bytes]:
    """Ids of every text of a column, in turn; null is empty; ``end_id`` ends each."""
    end = np.array([end_id], "<u4").tobytes()
    own = encoder(path)
    for at in range(0, len(column), 4096):
        some = column.slice(at, 4096).fill_null("").to_pylist()
        for ids in own.encode(some):
            yield ids + end
