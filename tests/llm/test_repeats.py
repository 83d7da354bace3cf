import hashlib
from collections import Counter

import numpy as np
import pytest

from planweave.llm import repeats, suffixes
from planweave.llm.anchors import WINDOW, parts, passages
from planweave.llm.repeats import without_repeats
from planweave.llm.suffixes import suffix_arrays


def plain_arrays(text, limit):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while n < limit and a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        shared.append(n)
    return order, shared


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays(tmp_path, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        monkeypatch.setattr(suffixes, "BATCH", int(rng.integers(1, 20)))
        monkeypatch.setattr(suffixes, "RANGE", int(rng.integers(1, 30)))
        monkeypatch.setattr(suffixes, "WAITING_BYTES", 200)
        monkeypatch.setattr(suffixes, "RESIDENT", int(rng.choice([10, 10**6])))
        body = rng.integers(1, rng.integers(2, 7), rng.integers(1, 60))
        if rng.random() < 0.4:
            body = np.tile(body[: max(1, len(body) // 4)], 4)
        text = np.append(body, 0).astype(np.uint16)
        order, lcp = suffix_arrays(text, int(text.max()) + 1, 10**6, str(tmp_path), internal=int(rng.choice([0, 5, 10**6])))
        assert (order.tolist(), lcp.tolist()) == plain_arrays(text.tolist(), 10**6)
    assert not list(tmp_path.iterdir())


def test_queue_on_disk(tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 60_000), 0).astype(np.uint16)
    whole = suffix_arrays(text, 5, 400, str(tmp_path))
    monkeypatch.setattr(suffixes, "WAITING_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "RANGE", 3_000)
    monkeypatch.setattr(suffixes, "BATCH", 1_000)
    spilled = []
    monkeypatch.setattr(suffixes.Spool, "spill", lambda self, f=suffixes.Spool.spill: (spilled.append(1), f(self))[1])
    parts = suffix_arrays(text, 5, 400, str(tmp_path), internal=1000)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and len(spilled) > 20
    assert not list(tmp_path.iterdir())


def test_passages_own_every_window_once():
    rng = np.random.default_rng(0)
    for data in (rng.integers(97, 100, 5000).astype(np.uint8), np.full(3000, 32, np.uint8), np.tile(rng.integers(97, 123, 37), 60).astype(np.uint8), rng.integers(97, 123, WINDOW).astype(np.uint8)):
        key, first, count, again, _ = passages(data)
        assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and first[-1] + count[-1] == len(data) - WINDOW + 1
        assert len(key) == len(again)
        key, first, count = parts(data)
        assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and first[-1] + count[-1] == len(data) - WINDOW + 1
    assert len(passages(np.full(WINDOW - 1, 32, np.uint8))[0]) == 0


def plain(texts):
    data = {i: (t or "").encode() for i, t in texts}
    seen = Counter(b[k : k + WINDOW] for b in data.values() for k in range(len(b) - WINDOW + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - WINDOW + 1):
            if seen[b[k : k + WINDOW]] > 1:
                gone[k : k + WINDOW] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out[i] = (len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])[: len(b)]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def texts():
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgé"), rng.integers(1, 9))) for _ in range(n))
    shared, base = words(100), words(400)
    rows = [base, base, base[:1500] + "X" + base[1501:], shared, words(50) + shared + words(60), shared[:399], "short", None, "", " " * 2000, "ab" * 900, words(30) + shared[:401] + "y" + shared[100:520], base * 3, words(900)]
    return list(enumerate(rows))


def test_against_every_window(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").selectExpr("*", "1 AS uid", "'x' AS key", "2 AS start")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in without_repeats(docs).collect()}
    assert found == plain(texts())
    assert sum(v[1] for v in found.values()) > 5000


def test_repeated_and_null_ids_are_separate_documents(spark):
    body = texts()[0][1]
    docs = spark.createDataFrame([(1, body), (1, body), (None, "q" + texts()[13][1]), (None, None), (2, texts()[13][1])], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["n_bytes"] - r["n_removed"]) for r in without_repeats(docs).collect())
    assert rows == [(-1, 0), (-1, 1), (1, 0), (1, 0), (2, 0)]
    assert without_repeats(docs.limit(0)).count() == 0


def test_hot_hashes_are_dealt_out(spark, monkeypatch):
    """Many texts that all have one passage, each with another surrounding, make one hash far larger than a shard."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefg"), rng.integers(1, 9))) for _ in range(n))
    shared = words(60)
    rows = [*texts(), *((100 + k, f"{words(40)} {shared[: 200 + 3 * k]} {words(40)} {shared}") for k in range(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in without_repeats(docs).collect()}
    assert found == plain(rows)


def test_queues_of_a_whole_shard_go_through_files(tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(97, 123, repeats.SHARD_BYTES // 4).astype(np.uint8).tobytes()
    spilled = []
    monkeypatch.setattr(suffixes.Spool, "spill", lambda self, f=suffixes.Spool.spill: (spilled.append(1), f(self))[1])
    texts = [base, base[: len(base) // 2] + b"!" + base[len(base) // 2 :]]
    a, b = repeats.repeated_starts(texts, [len(t) - WINDOW + 1 for t in texts], [1, 1], str(tmp_path))
    assert a.sum() == len(a) - (WINDOW - 1) and b.sum() == len(b) - WINDOW and len(spilled) > 10
    assert not list(tmp_path.iterdir())


def test_shorter_shared_strings_are_told(spark, monkeypatch):
    """Marks against common strings of two documents: always from 299 bytes on, never below 150; only other documents count."""
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))
    passages_ = [words(120) for _ in range(3)]
    twice = words(60)
    rows = [(0, words(90)), (1, twice[:380] + words(30) + twice[:380]), (2, None), (3, ""), (4, "ab" * 60)]
    for k, (text, n) in enumerate(zip(passages_, (299, 330, 149), strict=True)):
        rows += [(10 + 10 * k + i, f"{words(20 * i)}#{i}{text[40 : 40 + n]}{i}#{words(130 * (2 - i))}") for i in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r["doc_id"] for r in without_repeats(docs).filter("n_shared_marks > 0").collect()}
    assert told == {10, 11, 20, 21}
