import numpy as np
import pytest

from planweave.llm import lm


def texts(seed=0, n=150):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        state, words = 0, []
        for _ in range(rng.integers(30, 120)):
            state = (state * 3 + int(rng.integers(0, 2))) % 29
            words.append(f"w{state}")
        out.append(" ".join(words))
    return out


def trained(batch):
    form, document = lm.forms(batch)
    vocabulary = lm.Vocabulary(np.bincount(form, minlength=lm.FORMS).astype(float))
    network = lm.Network(unigram=vocabulary.unigram)
    squares, rng = np.full_like(network.values, 1e-6), np.random.default_rng(0)
    classes = vocabulary.of[form]
    near = lm.neighbours(classes, document)
    for _ in range(6):
        for a in range(0, len(classes), 256):
            network.step(near[:, a : a + 256], classes[a : a + 256], rng.choice(lm.CLASSES, lm.NEGATIVES, p=vocabulary.unigram), vocabulary.unigram, squares)
    return vocabulary, network


def test_probabilities_sum_to_one_over_classes():
    vocabulary, network = trained(texts(n=10))
    near = np.array([[3], [4], [5], [lm.CLASSES]])
    every = np.exp(network.log_probability(np.repeat(near, lm.CLASSES, axis=1), np.arange(lm.CLASSES)))
    assert every.sum() == pytest.approx(1.0, abs=1e-4)
    shares = np.bincount(vocabulary.of, np.exp(vocabulary.log_share), lm.CLASSES)
    assert shares == pytest.approx(np.ones(lm.CLASSES))


def test_learns_from_both_sides():
    vocabulary, network = trained(texts())
    form, document = lm.forms(texts(seed=1))
    classes = vocabulary.of[form]
    near = lm.neighbours(classes, document)
    learned = network.log_probability(near, classes).mean()
    assert learned > np.log(vocabulary.unigram[classes]).mean() + 0.8
    one_sided = near.copy()
    one_sided[2:] = lm.CLASSES
    assert learned > network.log_probability(one_sided, classes).mean()


def test_neighbours_stay_in_their_document():
    near = lm.neighbours(np.array([1, 2, 3, 4]), np.array([0, 0, 2, 2]))
    end = lm.CLASSES
    assert near.T.tolist() == [[end, end, 2, end], [end, 1, end, end], [end, end, 4, end], [end, 3, end, end]]


def test_score(spark):
    good = texts(n=200)
    rows = [*enumerate(good), (1000, " ".join(sorted(good[0].split()))), (1001, None), (1002, " \n"), (None, good[0]), (0, good[0]), (1003, good[1] + " x" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2.0 AS part").repartition(3)
    found = {}
    for r in lm.score(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    assert found[1001][0]["n_tokens"] == found[1002][0]["n_tokens"] == 0 and found[1001][0]["log_likelihood"] == 0 and found[1001][0]["mean_log_likelihood"] is None
    assert found[0][0]["log_likelihood"] == pytest.approx(found[None][0]["log_likelihood"]) == pytest.approx(found[0][1]["log_likelihood"])
    assert found[0][0]["mean_log_likelihood"] > found[1000][0]["mean_log_likelihood"]
    assert lm.score(docs.limit(0)).count() == 0


def test_exact_words_and_neighbours_decide(spark):
    """Words of one class, and of one form, are told apart by counts of the other documents, and words next to each other count."""
    rng = np.random.default_rng(3)
    rare = [f"r{k}" for k in range(2000)]
    common = [" ".join(rng.choice(rare, 40)) for _ in range(300)]
    new = " ".join(f"zq{k}" for k in range(40))
    twice = " ".join(rng.permutation(rare)[:40])
    mixed_up = " ".join(twice.split()[::-1])
    rows = [*enumerate(common), (1000, new), (1001, twice), (1002, twice), (1003, mixed_up)]
    found = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1001] == pytest.approx(found[1002]) and found[1001] > found[1003] + 1
    assert found[1003] > found[1000] + 1


def test_word_probabilities_sum_to_one():
    """Over all words that may stand at a place, with counts of the other texts."""
    vocabulary = [f"v{k}" for k in range(30)]
    rng = np.random.default_rng(4)
    others = [" ".join(rng.choice(vocabulary, 50)) for _ in range(4)]
    total = 0.0
    for w in vocabulary:
        block = lm.Block([*others, f"v1 {w} v2"], 3)
        counts = [(k, np.concatenate([block._counts(block.word, len(block.words))[:, a].ravel(), np.bincount(block.pair)[b]]).astype(np.int64)) for k, (a, b) in enumerate(zip(*block.buckets))]
        of_words, of_pairs = block.elsewhere(iter(counts))
        total += np.exp(block.log_probability(np.full(203, 1 / 30), of_words, of_pairs)[201])
    assert total == pytest.approx(1.0)


def test_tables_without_any_word(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_tokens"], r["log_likelihood"], r["mean_log_likelihood"]) for r in lm.score(docs).collect()) == [(k, 0, 0.0, None) for k in (1, 2, 3)]
    some = docs.union(spark.createDataFrame([(4, "one two two")], docs.schema)).repartition(1)
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score(some).collect()} == {1: 0, 2: 0, 3: 0, 4: 3}


def test_one_score_by_hand(spark):
    """The score of a document, from the counts of the others and the network's class probabilities, word by word."""
    rows = ["a b c a b", "b c a", "c c b a", "d a b"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    vocabulary, network = learned = lm.learn(docs)
    found = {r["doc_id"]: r["log_likelihood"] for r in lm.score(docs, learned).collect()}
    corpus = [r.split() for r in rows]
    class_of = {w: int(vocabulary.of[lm.forms([w])[0][0]]) for r in corpus for w in r}
    for k, own in enumerate(corpus):
        others = [r for j, r in enumerate(corpus) if j != k]
        n = lambda w: sum(r.count(w) for r in others)  # noqa: E731, B023
        pairs = [p for r in others for p in zip(r, r[1:], strict=False)]  # noqa: F841
        classes = [lm.CLASSES, lm.CLASSES, *(class_of[w] for w in own), lm.CLASSES, lm.CLASSES]
        total = 0.0
        for i, w in enumerate(own):
            near = np.array([[classes[i + 2 + s]] for s in lm.SIDES])
            fellows = [x for x in class_of if class_of[x] == class_of[w]]
            base = np.exp(network.log_probability(near, np.array([class_of[w]]))[0]) * (n(w) + lm.NEW) / sum(n(x) + lm.NEW for x in fellows)
            left = right = base
            if i:
                left = (pairs.count((own[i - 1], w)) + lm.PRIOR * base) / (sum(a == own[i - 1] for a, _ in pairs) + lm.PRIOR)
            if i + 1 < len(own):
                right = (pairs.count((w, own[i + 1])) + lm.PRIOR * base) / (sum(b == own[i + 1] for _, b in pairs) + lm.PRIOR)
            total += np.log((left + right) / 2)
        assert found[k] == pytest.approx(total, rel=1e-5)


def test_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    docs = spark.createDataFrame([(k, f"w{k} x") for k in range(40)], "doc_id long, text string").repartition(11)
    vocabulary, _ = lm.learn(docs)
    assert vocabulary.unigram.sum() == pytest.approx(1.0)
    counts = np.bincount(lm.forms([f"w{k} x" for k in range(40)])[0], minlength=lm.FORMS)
    assert vocabulary.unigram == pytest.approx(lm.Vocabulary(counts.astype(float)).unigram)
