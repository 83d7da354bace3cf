import public_tokenizers
import pytest

import corpus_pipeline
from planweave.llm import pii
from planweave.llm.packing import token_ids
from planweave.llm.shingles import shingle_sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows on the smallest documents, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.limit(1).selectExpr("CAST(9000 AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    digits = docs.limit(1).selectExpr("CAST(9001 AS BIGINT) AS doc_id", "'12 34' AS text", "lang", "source", "CAST(5 AS BIGINT) AS n_chars")
    copy = docs.filter("doc_id = 5").selectExpr("CAST(9002 AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")
    docs = docs.union(extra).union(digits).union(copy)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], "").write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert [s.columns for s in stages[:-1]] == [COLUMNS] * 5


def test_language_drops_only_what_has_none(stages):
    assert ids(stages[0]) - ids(stages[1]) == {9000, 9001}


def test_one_of_each_group_stays(stages):
    rows = stages[1].collect()
    sets = dict(zip((r["doc_id"] for r in rows), (set(s.tolist()) for s in shingle_sets([r["text"] for r in rows])), strict=True))
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                group[max(p, q)] = min(p, q)
    assert ids(stages[2]) == {i for i in sets if find(i) == i} and 9002 not in ids(stages[2])


def test_personal_data_is_gone(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    for r in stages[3].collect():
        spans = pii.base_spans(before[r["doc_id"]]["text"])
        assert not any(before[r["doc_id"]]["text"][a:b] in r["text"] for a, b, k in spans if k != "ip")
        assert r["n_chars"] == len(r["text"])
        if not spans and not pii.find(before[r["doc_id"]]["text"], pii.SemiMarkov(*pii.trained()))[1]:
            assert r["text"] == before[r["doc_id"]]["text"]
    assert len(before) == stages[3].count()


def test_mixing_keeps_the_asked_share(stages):
    words = lambda df: sum(len(r["text"].split()) for r in df.select("text").collect())
    assert ids(stages[4]) <= ids(stages[3])
    assert words(stages[4]) == pytest.approx(corpus_pipeline.KEPT_TOKENS * words(stages[3]), rel=0.2)


def test_packing_holds_every_token(stages):
    path = public_tokenizers.path("byte_bpe_50k.json")
    wanted = {r["doc_id"]: len(token_ids(r["text"], path)) for r in stages[4].collect()}
    found = {}
    for r in stages[5].collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == wanted


def test_run_gives_what_the_stages_give(spark, tmp_path):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 50
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_columns_of_any_name(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 AS n", "'s' AS __source", "'t' AS mix_topic", "2 AS component_id", "3 AS mark")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns and not docs.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
