import random
import zlib
from collections import defaultdict

import llm_cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plainspeak.llm import packing
from plainspeak.llm.tokens import Encoder


@pytest.fixture(scope="module")
def model():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_ids_equal_the_tokenizers_library(model):
    r = random.Random(5)
    signs = [" ", "\n", "\t", "a", "é", "12", ".", ",", "'s", "the", "  ", "　", "\r\n", "<|endoftext|>", "𝒳", "\0"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 15))) for _ in range(500)]
    encoder = Encoder()
    for text in texts:
        assert list(encoder.encode(text)) == model.encode(text, add_special_tokens=False).ids


def test_texts_that_the_fast_library_gives_up_on():
    assert len(Encoder().encode(" " * 2_000_000)) == 2_000_000


@pytest.mark.parametrize("size", [64, 1024])
def test_pieces_and_places(spark, model, size):
    found = packing.pack(llm_cases.rows(spark), size=size, with_ids=True).collect()
    used = defaultdict(list)
    for r in found:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= size
    for places in used.values():  # gapless from 0, never too long
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    # Pieces put together are the documents.
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append(r)
    want = defaultdict(list)
    for row in llm_cases.ROWS:
        ids = [*model.encode(row[1] or "", add_special_tokens=False).ids, 2]
        want[row[0]].append(np.array(ids, "<u4").tobytes())
    for doc_id, texts in want.items():
        mine = sorted((r["start"], r["piece"], bytes(r["ids"])) for r in by_id[doc_id])
        if len(texts) == 1:
            assert b"".join(x[2] for x in mine) == texts[0]
            assert [x[1] for x in mine] == list(range(len(mine)))
            assert all(len(x[2]) == 4 * size for x in mine[1:])
        else:
            assert sorted(x[2] for x in mine) == sorted(texts)


def brute_best_fit(lengths, size):
    """One piece at a time, longest first, into the smallest gap that is large enough."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gap = min(fits) - n
        else:
            gap = size - n
        gaps.append(gap)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_as_few_sequences_as_best_fit(seed):
    r = random.Random(seed)
    size = r.choice([16, 100, 257])
    lengths = [r.randint(1, size) for _ in range(300)] + [r.randint(1, 1 + size // 6) for _ in range(r.choice([0, 400]))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    moves, opened = packing.best_fit(counts, size)
    assert opened == brute_best_fit(lengths, size)
    placed = defaultdict(list)
    for length, rank, n, first, offset in moves:
        for i in range(n):
            placed[first + i].append((offset, length))
    assert sum(map(len, placed.values())) == len(lengths) and set(placed) == set(range(opened))
    for places in placed.values():
        assert [p[0] for p in sorted(places)] == [sum(q[1] for q in sorted(places)[:i]) for i in range(len(places))]
        assert sum(p[1] for p in places) <= size


def test_empty_table(spark):
    assert packing.pack(llm_cases.none(spark)).count() == 0
