import zlib
from bisect import insort
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from planweave.llm import packing
from planweave.llm.packing import CapacityTree, best_fit_decreasing, pack, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, window):
    rooms, windows = [], []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= n), None)
        room = window if k is None else rooms.pop(k)
        insort(rooms, room - n)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice([10, 64, 1024]))
    lengths = rng.integers(1, window + 1, int(rng.integers(0, 400))).tolist()
    slots = best_fit_decreasing(Counter(lengths), window)
    used, ranks = {}, Counter()
    for length, first_rank, pieces, per, sequence, offset in slots:
        assert first_rank == ranks[length] and pieces % per == 0
        ranks[length] += pieces
        for k in range(pieces):
            used.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
    assert ranks == Counter(lengths)
    rooms = Counter()
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        rooms[window - at] += 1
    assert rooms == plain_best_fit(lengths, window)
    assert sorted(used) == list(range(len(used)))


def test_capacity_tree():
    rng = np.random.default_rng(0)
    tree, held = CapacityTree(37), Counter()
    for _ in range(500):
        c = int(rng.integers(0, 38))
        change = int(rng.integers(-1, 3))
        if held[c] + change >= 0:
            held[c] += change
            tree.add(c, change)
        least = int(rng.integers(0, 38))
        assert tree.tightest(least) == min((c for c, n in held.items() if n and c >= least), default=None)


def test_same_ids_as_the_tokenizers_library(spark):
    known = Tokenizer.from_file(PATH)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "  a\n\n b\t", "<|endoftext|>", "a<|endoftext|>b", "x <|endoftext|>\n<|endoftext|><|endof", "it's we'LL  I'm", "日本語 ½ ١٢ ǅ ª", "é" * 3000, "​ x y", "a" * 5000, "🙂🙂 ퟿", "1234567 12a b_c --- ##", "don’t"]
    for text, wanted in zip(texts, known.encode_batch(texts, add_special_tokens=False), strict=True):
        assert token_ids(text, PATH).tolist() == [*wanted.ids, 0], text[:50]


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 5)
    rows = [(1, "a b c"), (2, None), (3, ""), (1, "a b c"), (None, "x"), (4, "word " * 5000), *((k, "p q " * (k % 40)) for k in range(10, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'l' AS length", "1 AS block", "2 AS rank")
    found = pack(docs, window=64).collect()
    tokens = Counter()
    for doc_id, text in rows:
        ids = token_ids(text, PATH)
        for start in range(0, len(ids), 64):
            piece = ids[start : start + 64]
            tokens[doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in found) == tokens
    windows = {}
    for r in found:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    pieces = [n for (_, _, n, _, _), c in tokens.items() for _ in range(c)]
    assert len(windows) == sum(plain_best_fit(pieces, 64).values())
    assert pack(docs.limit(0)).count() == 0
