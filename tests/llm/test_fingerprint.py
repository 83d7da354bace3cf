import hashlib
import re

import numpy as np
import pytest

from planweave.llm.fingerprint import fingerprints, with_fingerprint


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_against_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    rows = fingerprints(docs).orderBy("doc_id").collect()
    errors = []
    for k, r in enumerate(rows):
        following = texts[(k + 1) % len(texts)]
        new = edited(texts[k], following)
        assert r["n_chars"] == len(texts[k]) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        errors += [r["near_edited"] - likeness(texts[k], new), r["near_next"] - likeness(texts[k], following)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.07


def test_sparse_ids_odd_texts_and_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(10**12, "a b c d e f"), (-5, "A  b\tc D e f"), (7, ""), (8, None), (9, "only three words"), (9, "only three words"), (3, long), (4, long), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_chars", "'z' AS fingerprint", "2 AS part", "3 AS id")
    found = {}
    for r in fingerprints(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows) and len(found[9]) == 2
    assert found[-5][0]["fingerprint"] == found[10**12][0]["fingerprint"] == found[None][0]["fingerprint"]
    assert found[7][0]["fingerprint"] == found[8][0]["fingerprint"] == "" and found[7][0]["near_next"] == 1.0
    assert found[3][0]["near_next"] == 1.0 and found[3][0]["near_edited"] == pytest.approx(likeness(long, edited(long, long)), abs=0.1)
    assert found[10**12][0]["edited_sha256"] == hashlib.sha256(edited("a b c d e f", "A  b\tc D e f").encode()).hexdigest()
    assert found[None][0]["near_next"] == 0.0
    assert {len(r["fingerprint"]) for rs in found.values() for r in rs} == {0, 256}
    assert fingerprints(docs.limit(0)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = with_fingerprint(spark.range(3).selectExpr("CAST(id AS STRING) AS t"), "t", "f")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_short_sets_are_filled_alike(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 3, k % 3 + 9))) for k in range(3)], "id long, t string")
    marks = [r["f"] for r in with_fingerprint(docs, "t", "f").orderBy("id").collect()]
    for a in range(2):
        same = np.mean([x == y for x, y in zip(marks[a], marks[a + 1], strict=True)])
        assert abs((same - 1 / 16) / (15 / 16) - 4 / 6) < 0.35
