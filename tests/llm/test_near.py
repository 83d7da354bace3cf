import random

import numpy as np
import pytest

from planweave.llm import ngram_join
from planweave.llm.components import connected
from planweave.llm.ngram_join import near_groups, tree_links
from planweave.llm.shingles import shingle_sets


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_groups(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(plain_set(t))
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                group[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def family(seed=4, families=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    common = [word() for _ in range(40)]
    rows, k = [], 0
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([3, 5, 6, 20, 60, 150]))] + (common if rnd.random() < 0.5 else [])
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((k * 7, " ".join(copy)))
            k += 1
    return rows


def test_sets_of_shingles():
    texts = [None, "", " \t\n", "one", "a b c d", "A b C d e", "a b c d e f a b c d e", "x\x85y z", "é É"]
    for text, found in zip(texts, shingle_sets(texts), strict=True):
        assert len(found) == len(plain_set(text)), text
    assert (shingle_sets(["A b C d e"])[0] == shingle_sets(["a B c D E"])[0]).all()
    assert shingle_sets(["a b"])[0][0] != shingle_sets(["b a"])[0][0]
    joined = shingle_sets(["p q r s t u", "r s t u v"])
    alone = [shingle_sets([t])[0] for t in ("p q r s t u", "r s t u v")]
    assert all((a == b).all() for a, b in zip(joined, alone, strict=True))


@pytest.mark.parametrize("seed", range(5))
def test_prefix_tree_finds_all_components(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(30):
        base = rng.choice(400, rng.integers(1, 60), replace=False)
        for _ in range(rng.integers(1, 5)):
            keep = base[rng.random(len(base)) > 0.06]
            sets.append(np.unique(np.append(keep, rng.integers(0, 400, rng.integers(0, 3)))).astype(np.uint64))
    sets = [s for s in sets if len(s)]
    links = tree_links(list(range(len(sets))), sets)
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        assert 100 * len(x & y) >= 80 * len(x | y)
        group[max(find(a), find(b))] = min(find(a), find(b))
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 100 * len(x & y) >= 80 * len(x | y):
                assert find(a) == find(b)


@pytest.mark.parametrize("block", [512, 7, 3, 1])
def test_groups_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "CLUSTER_BLOCK", block)
    rows = family() + [(5001, None), (5002, ""), (5003, "  "), (5004, "one two"), (5005, "ONE  two"), (5006, "two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS n", "'m' AS mark", "1 AS shared").repartition(5)
    found = near_groups(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_groups(rows)
    sizes = {i: len(plain_set(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in found) and len(found) == len(rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(9, text), (9, text), (4, text + " x"), (None, text), (7, "other words that stand all alone here")], "doc_id long, text string")
    found = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in near_groups(docs).collect())
    assert found == [(-1, 26, None), (4, 27, 4), (7, 3, 7), (9, 26, 4), (9, 26, 4)]
    assert near_groups(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(200, 100 + k) for k in range(40)] + [(300, 300)]
    random.Random(1).shuffle(chain)
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in [*range(100, 140), 200]}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_one_id_with_different_texts_keep_all_links(spark):
    one, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    near = {2: one + " tail", 3: other + " tail"}
    rows = [(1, one), (1, other), *near.items(), (9, "alone in the world of all words")]
    got = {(r["doc_id"], r["component_id"]) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 9)}
