from collections import Counter

import numpy as np
import pytest

from planweave.llm.mixing import TOPICS, assignments, mixed, topic_and_tokens


def rows():
    rng = np.random.default_rng(0)
    out = []
    for k in range(900):
        source = "big" if rng.random() < 0.4 else f"s{rng.integers(0, 6)}"
        lang = str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1]))
        out.append((k, source, lang, "word " * int(rng.integers(1, 60)) + ("license " if rng.random() < 0.2 else "")))
    return out


def plain_rake(cells, goals):
    weights = dict.fromkeys(cells, 1.0)
    for _ in range(500):
        for axis, goal in enumerate(goals):
            sums = Counter()
            for c, n in cells.items():
                sums[c[axis]] += n * weights[c]
            for c in cells:
                weights[c] *= goal[c[axis]] / sums[c[axis]]
    return weights


def test_against_plain_raking(spark):
    data = rows()
    found = assignments(spark.createDataFrame(data, "doc_id long, source string, lang string, text string"), keep_share=0.4).collect()
    cells = Counter()
    for r in found:
        cells[r["source"], r["lang"], r["topic"]] += r["tokens"]
    totals = [Counter() for _ in range(3)]
    for c, n in cells.items():
        for axis in range(3):
            totals[axis][c[axis]] += n
    goals = [{k: n**0.5 / sum(m**0.5 for m in t.values()) for k, n in t.items()} for t in totals]
    plain = plain_rake(cells, goals)
    scale = next(r["weight"] * r["probability"] / plain[r["source"], r["lang"], r["topic"]] for r in found)
    for r in found:
        assert r["weight"] * r["probability"] == pytest.approx(plain[r["source"], r["lang"], r["topic"]] * scale, rel=1e-4)
        assert r["probability"] <= 1 and (r["weight"] == 1 or r["probability"] == 1)
    assert sum(r["probability"] * r["tokens"] for r in found) == pytest.approx(0.4 * sum(cells.values()), rel=1e-4)
    kept = sum(r["tokens"] for r in found if r["kept"])
    assert kept == pytest.approx(0.4 * sum(cells.values()), rel=0.15)


def test_given_targets(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, source string, lang string, text string")
    found = assignments(docs, lang_targets={"en": 1.0, "de": 1.0, "fr": 2.0}, source_targets={"big": 1.0, **{f"s{k}": 1.0 for k in range(6)}}).collect()
    weighted = Counter()
    for r in found:
        weighted[r["lang"]] += r["weight"] * r["probability"] * r["tokens"]
    total = sum(weighted.values())
    assert weighted["fr"] / total == pytest.approx(0.5, abs=1e-4) and weighted["de"] / total == pytest.approx(0.25, abs=1e-4)


def test_odd_rows(spark):
    data = [(1, None, None, "a b"), (2, "x", None, None), (3, None, "en", ""), (None, "x", "en", "a b c"), (4, "x", "en", "a " * 50_000), (4, "x", "en", "a " * 50_000)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, text string").selectExpr("*", "1 AS tokens", "'t' AS topic", "2 AS factor")
    found = assignments(docs).collect()
    assert len(found) == len(data) and all(0 <= r["probability"] <= 1 for r in found)
    assert len({r["kept"] for r in found if r["doc_id"] == 4}) == 1
    out = mixed(docs, keep_share=1.0)
    assert out.columns == docs.columns and out.filter("doc_id = 4").count() == 2
    assert assignments(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0


def test_topics():
    assert topic_and_tokens("The License and the LICENSE of a token", TOPICS) == ("law", 8)
    assert topic_and_tokens(None, TOPICS) == topic_and_tokens("", TOPICS) == ("general", 0)
    assert topic_and_tokens("token license", TOPICS)[0] == "computing"


def test_columns_of_any_name_stay(spark):
    rows = [(k, f"s{k % 3}", "en", "word " * (k % 7 + 1)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").selectExpr("*", "1 AS mix_topic", "2 AS mix_tokens", "'x' AS __source", "3 AS __factor", "4 AS __salt", "5 AS n", "6 AS mix_kept", "7 AS own_4")
    kept = mixed(docs, 0.5)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert 0 < len(found) < 60 and {tuple(r[4:]) for r in found} == {(1, 2, "x", 3, 4, 5, 6, 7)}
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in mixed(docs.select("doc_id", "source", "lang", "text"), 0.5).collect()}


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x " * 400_000), (2, "b", "en", "license " * 3)], "doc_id long, source string, lang string, text string")
    assert {(r["doc_id"], r["tokens"], r["topic"]) for r in assignments(docs).collect()} == {(1, 400_000, "general"), (2, 3, "law")}
