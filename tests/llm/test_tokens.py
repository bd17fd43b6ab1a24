import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stellarate.llm import packing, token_files, tokens
from stellarate.session import scratch_path
from tests.llm import common

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
OWN = tokens.WordEncoder(PATH)


def ids_of(text: str | None, end: int) -> list[int]:
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text_encodes_as_the_whole(texts):
    for text, ids in zip(texts, OWN.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text, 0)[:-1]


def test_odd_texts_encode_as_the_whole():
    texts = [
        "It's we'll 'S ''s don't. Don't!", "<|endoftext|> a<|startoftext|>b <|endof text|>",
        "ΑΣ ΣΑΣ. İstanbul ẞß ŉ Ǆ", "é a ́b c d\u001ce\u0085f", "abc<| x|> ...!?,",
        "x" * 5000, "Été!! ÉTÉ,### naïve%%% 12abc 3.14 v2.0", "a\r\nb\tc\x0bd  e \n\n f", "🙂👍🏽 汉字かな",
    ]
    for text, ids in zip(texts, OWN.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text, 0)[:-1], text


def test_long_text_and_small_caches(monkeypatch):
    for name, value in (("CHARACTERS", 1000), ("MOST_PARTS", 500)):
        monkeypatch.setattr(tokens, name, value)
    small = tokens.WordEncoder(PATH)
    text = common.prose(1, 3000)
    assert small.encode([text, text]) == OWN.encode([text, text])
    assert 1 < len(small.number) <= 500 and len(small.length) == len(small.start) == len(small.number)
    assert small.length.sum() == len(small.ids)


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for ids in (
        np.zeros(0, np.uint32), np.array([7]), np.array([255, 256, 65535, 65536, 2**32 - 1]),
        rng.integers(0, 300, 5000), rng.integers(0, 49408, 20_001), np.full(1024, 70_000),
    ):
        codes = token_files.Codes(token_files.write_codes(ids))
        assert codes.count == len(ids)
        places = rng.integers(0, max(len(ids), 1), 200) if len(ids) else np.zeros(0, int)
        assert np.array_equal(codes.get(places), ids[places])
        for _ in range(30):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert np.array_equal(codes.slice(a, b), ids[a:b])


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_token_files(spark, monkeypatch, shard):
    monkeypatch.setattr(token_files, "SHARD_IDS", shard)
    rows = common.awkward()
    path = scratch_path(spark, "shards")
    token_files.write_shards(common.docs_of(spark, rows), PATH, path)
    got = token_files.read_documents(spark, path).collect()
    # within one doc_id by the ids' bytes, as two-byte numbers
    ordered = sorted(
        ((d is not None, d or 0), np.array(i, "<u2").tobytes(), d, i)
        for d, i in ((d, ids_of(t, 2)) for d, t in rows)
    )
    start, expected = 0, []
    for _, _, d, ids in ordered:
        expected.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    common.same(got, expected)


def test_token_files_of_nothing(spark):
    path = scratch_path(spark, "shards")
    token_files.write_shards(common.docs_of(spark, []), PATH, path)
    assert token_files.read_documents(spark, path).collect() == []


def test_packing(spark):
    rows = common.awkward()
    got = packing.pack(common.docs_of(spark, rows), PATH).collect()
    pieces = []
    for d, t in rows:
        ids = ids_of(t, 1)
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            pieces.append((d, n, at, len(part), crc(part)))
    common.same([(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got], pieces)
    for own in common.grouped((r.sequence_id, (r.offset, r.length)) for r in got).values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096


def test_packing_nothing(spark):
    assert packing.pack(common.docs_of(spark, []), PATH).collect() == []


def test_fullest_sequence_takes_and_closes():
    """Against a plain search through a list of open sequences."""
    rng = random.Random(2)
    own = packing.OpenSequences(100, 5)
    open_: dict[int, int] = {}
    for _ in range(2000):
        length = rng.randint(1, 100)
        number, offset = own.place(length)
        fits = [free for free in open_.values() if free >= length]
        if fits:
            assert 100 - offset == min(fits) == open_[number]
        else:
            assert offset == 0 and number not in open_
            if len(open_) == 5:
                least = min(open_.values())
                tied = [n for n, f in open_.items() if f == least]
                held = {n for numbers in own.by_free.values() for n in numbers} | {number}
                gone = [n for n in tied if n not in held]
                assert len(gone) == 1
                del open_[gone[0]]
            open_[number] = 100
        open_[number] -= length
        if not open_[number]:
            del open_[number]
