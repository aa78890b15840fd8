"""The pipeline's stages one after the other, each against what it must do with its own input."""

import pytest

import corpus_pipeline as P
from inkstream.llm import ngram_join, packing

from .helpers import awkward, clashing, documents
from .test_pairs import brute, brute_lines


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        f(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    first = stages[0][0].columns
    assert all(after.columns == first for _, after in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(before.select("doc_id"), "doc_id")
    kept = {r.doc_id for r in after.collect()}
    clean = [r.doc_id in kept for r in labels.where("toxic = 0").collect()]
    assert sum(clean) / len(clean) > 0.97


def test_repeated_lines_go(stages):
    before, after = stages[1]
    want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == {d: t for d, t in want.items() if t.strip()}


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    group = brute([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == set(group.values())


def test_mix_and_pack(stages):
    before, after = stages[3]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert after.groupBy("doc_id").count().selectExpr("max(count)").first()[0] <= 2
    before, after = stages[4]
    assert after.where("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").first()[0] <= packing.WINDOW


def test_run_equals_the_stages(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(P.run(spark, sf)) == key(stages[-1][1])


def test_further_columns_stay(spark, sf):
    docs = clashing(spark.read.parquet(f"{sf}/documents.parquet"))
    for _, f in P.STAGES[:-1]:
        assert f(spark, docs, sf).columns == docs.columns


def test_wider_groups_stay_whole(spark):
    assert ngram_join.NGRAM == 5


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_awkward_and_empty_documents_pass_all_stages(spark, sf, tmp_path, kind):
    """Null and repeated ids, null and empty texts; and no documents at all."""
    docs = documents(spark, awkward() + [(None, None, None, None, None)] * 3)
    if kind == "empty":
        docs = docs.limit(0)
    counts = []
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts == [0] * 5 if kind == "empty" else all(counts)
