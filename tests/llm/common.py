"""Small tables with awkward rows, and brute-force versions to compare with."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame, SparkSession

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp long, kind string, bucket int, n long, root string, anchor string, _rows int, label string"
)
CLASHING = ("x", 1, "y", 2, 3, "z", "w", 4, "v")


def docs_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows as documents with further columns, some named like inner ones."""
    full = [
        (d, t, "en", "src0", None if t is None else len(t), i, *CLASHING[0:1], *CLASHING[1:2],
         *CLASHING[3:4], *CLASHING[2:3], *CLASHING[5:6], *CLASHING[7:8], *CLASHING[8:9])
        for i, (d, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, DOCS).repartition(2)


def prose(seed: int, words: int, letters: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join(
        "".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(words)
    )


def awkward() -> list[tuple]:
    """Nulls, empty and blank texts, one long text, ties, repeated rows, shared ids."""
    shared = prose(1, 60)
    long_text = prose(2, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, shared), (5, shared),
        (6, shared + " end"), (7, prose(3, 40) + "\n" + shared), (None, shared), (None, None),
        (8, long_text), (9, long_text[:5000] + " x " + long_text[5000:9000]),
        (10, "aé" * 400), (11, "a" * 350), (11, prose(4, 50)), (12, "é" + shared[:130]),
    ]


class Sets:
    """Union-find."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    runs = runs or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    bits = (b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return sum(1 << b for b in bits)


def near_copies(rows: list[tuple], radius: int = 4) -> list[tuple]:
    """(doc_id, fingerprint, component_id) of each row, all pairs compared."""
    prints = [fingerprint(t) for _, t in rows]
    sets = Sets()
    values = sorted(set(prints))
    for i, a in enumerate(values):
        for b in values[i:]:
            if (a ^ b).bit_count() <= radius:
                sets.join(a, b)
    low: dict = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            low[sets.find(p)] = min(d, low.get(sets.find(p), d))
    return [(d, f"{p:016x}", low.get(sets.find(p))) for (d, _), p in zip(rows, prints)]


def repeats(rows: list[tuple], span: int = 100) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha) of each row, and the cut text, by all strings."""
    low = -(1 << 63)
    first: dict = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - span + 1):
            key = (low if d is None else d, i)
            window = data[i : i + span]
            first[window] = min(first.get(window, key), key)
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if first[data[i : i + span]] < (low if d is None else d, i):
                gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        row = (d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        out.append((row, kept.decode("utf-8", "ignore")))
    return out


def shingle_set(text: str | None, size: int = 5) -> set:
    words = (text or "").encode().lower().split()
    span = min(size, len(words))
    return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if span else set()


def contained(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    out = []
    for d, t in rows:
        own = shingle_set(t)
        for item, text in items:
            wanted = shingle_set(text)
            if wanted and 5 * len(own & wanted) >= 4 * len(wanted):
                out.append((d, item, len(wanted), len(own & wanted)))
    return out


def key(row: tuple) -> tuple:
    return tuple((x is not None, x) if x is not None else (False, 0) for x in row)


def same(found: list, expected: list) -> None:
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


def grouped(pairs) -> dict:
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return dict(out)
