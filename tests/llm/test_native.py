"""Mixing and chat rotation, with their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from inkstream.llm import chat, mixing, shared
from inkstream.llm.queries import ORACLES, QUERIES

from ..test_queries import rows
from .helpers import clashing, documents


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(f"_{name}", t.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def fixed_targets(sizes, share=1.5):
    """The rule as said: share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, done = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in done]
        level = (total - sum(done.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return done | {s: level * w[s] for s in free}
        done |= {s: 2.0 * sizes[s] for s in over}


def test_targets(spark):
    sizes = {"a": 100, "b": 5000, "c": 10, "d": 700, "é": 900, None: 40, "z": 3}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = fixed_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_mix_near_targets_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mix_plan(docs, bucket_rows=3)
    a = plan.groupBy("source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most"), F.max("size").alias("big")).collect()
    assert all(r.most <= 2 and abs(r.taken - r.target) <= r.big / 2 + 1 for r in a)
    key = lambda p: sorted((r.doc_id, r.copies) for r in p.collect())
    assert key(plan) == key(mixing.mix_plan(docs.repartition(7)))
    same(mixing.op9(spark, sf), mixing.ORACLE, documents=docs)


def test_priority_raises_inclusion(spark):
    rows_ = [(i, "w " * 10, "en", "a", 1) for i in range(400)] + [(1000 + i, "w " * 10, "en", "b", 1) for i in range(400)]
    df = documents(spark, rows_).withColumn("priority", F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0))
    got = mixing.mix_plan(df, share=0.5, priority="priority").where("copies > 0").groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    n = {r.odd: r["count"] for r in got}
    assert n[0] > 1.5 * n[1]


def test_inclusion_frequencies_are_the_probabilities(spark):
    """Two hundred sources of the same sizes are as many draws; equal classes of a weight have equal rates."""
    sizes = [1, 3, 6, 6, 12, 25, 25, 50, 50, 100, 100, 100, 200, 200, 400] * 8
    rows_ = [(1000 * s + i, "w " * n, "en", f"s{s:04d}", 1) for s in range(210) for i, n in enumerate(sizes)]
    got = mixing.mix_plan(documents(spark, rows_)).groupBy("size", F.round("rate", 6).alias("rate")).agg(F.avg("copies").alias("mean"), F.count(F.lit(1)).alias("n")).collect()
    uneven = [r for r in got if r.rate % 1 > 0]
    assert len(uneven) >= 10 and len({r.rate for r in uneven}) >= 8 and all(r.n >= 500 for r in uneven)
    assert all(abs(r["mean"] - r.rate) < 0.06 for r in uneven), [(r.size, r.rate, r["mean"]) for r in uneven]
    assert all(r["mean"] == r.rate for r in got if r.rate % 1 == 0)


def test_documents_behind_a_long_one_fill_the_gap(spark):
    """However a long document stands in the order, the short ones behind it are still taken."""
    rows_ = [(100 * s + i, "w " * n, "en", f"s{s:03d}", 1) for s in range(60) for i, n in enumerate([600] + [10] * 40)]
    got = mixing.mix_plan(documents(spark, rows_), bucket_rows=7).groupBy("target", F.floor(F.col("doc_id") / 100).alias("s")).agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert len(got) == 60 and sum(abs(r.taken - r.target) > 5.01 for r in got) <= 6 and all(abs(r.taken - r.target) <= 300 for r in got)


def test_repeated_rows_share_their_copies(spark):
    rows_ = [(7, "one two three", "en", "a", 1)] * 50 + [(8, "x " * 40, "en", "b", 1)] * 3 + [(None, None, None, None, None)] * 4
    df = documents(spark, rows_)
    want = mixing.mix_plan(df).agg(F.sum("copies")).first()[0]
    assert mixing.mix(df).count() == want


def test_texts_are_read_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mix_plan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "documents.parquet" not in plan


def test_mix_awkward_rows(spark):
    df = clashing(documents(spark))
    out = mixing.mix(df)
    assert out.columns == df.columns
    same(mixing.mix_plan(documents(spark)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")), mixing.ORACLE, documents=documents(spark))
    assert mixing.mix_plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def test_rotation(spark):
    t = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None)], TURNS)
    got = chat.rotate(t).orderBy("perspective", "turn").collect()
    ann = [r for r in got if r.perspective == "ann"]
    text = "".join(r.segment for r in ann)
    assert text == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [text[r.mask_start : r.mask_end] for r in ann if r.learn] == ["hi<|im_end|>\n", "<|im_end|>\n"]
    assert all(text[r.char_start : r.char_end] == r.segment for r in ann) and len(got) == 8


@pytest.mark.parametrize("block", [1, 3, 64])
def test_rotation_awkward_rows(spark, block):
    data = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, None, None, "y"), (None, 1, "b", "é🙂"), (None, 2, "a", ""), (2, 5, "system", "only"), (3, None, None, None), (1, 200, "b", "z" * 5000), (1, -5, "c", "n")]
    t = spark.createDataFrame(data, TURNS).withColumn("block", F.lit("own")).withColumn("size", F.lit(1))
    same(chat.rotate(t, block), chat.ORACLE, conversations=t.select("conv_id", "turn", "role", "text"))
    assert chat.rotate(t.limit(0)).count() == 0


def test_no_python_in_native_plans(spark, sf):
    for q in (chat.op2, mixing.op9):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_conversation_with_most_of_all_turns(spark):
    """Its turns meet their seats block by block: no key of the join has more rows than a block."""
    data = [(7, i, ["ann", "bob", "cy"][i % 3], "x" * (i % 5)) for i in range(3000)] + [(100 + i, 0, "ann", "hi") for i in range(50)]
    t = spark.createDataFrame(data, TURNS)
    same(chat.rotate(t), chat.ORACLE, conversations=t)
    plan = chat.rotate(t)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x]
    assert any("block" in x for x in joins)


def test_a_cluster_must_name_the_shared_folder(spark):
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared.work_dir(Cluster)
    assert shared.work_dir(spark)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_registered_queries_equal_their_sql(spark, sf, name):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages", "conversations")}
    same(QUERIES[name](spark, sf), ORACLES[name], **tables)
