"""Chat formatting and the pipeline."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from imputeflow.llm import chat, queries


def test_snapshots_collapse(spark):
    turns = [("a", 0, "user", "hi"), ("a", 1, "assistant", "yes"), ("b", 0, "user", "hi"), ("c", 5, "user", "hi"),
             ("c", 7, "assistant", "yes"), ("d", 0, "user", "hi"), ("d", 1, "assistant", "no"), ("e", None, None, None),
             ("e", None, None, None), (None, 0, "user", "hi"), ("f", 0, "user", ""), ("f", 1, "user", "x" * 50_000)]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string").selectExpr("*", "1 as a")
    got = chat.render(df).orderBy("conv_id", "turn_no").collect()
    assert [(r["conv_id"], r["n_turns"], r["n_equal"], r["turn_no"]) for r in got] == [
        ("a", 2, 2, 1), ("a", 2, 2, 2), ("d", 2, 1, 1), ("d", 2, 1, 2), ("e", 1, 1, 1), ("f", 2, 1, 1), ("f", 2, 1, 2)]
    assert got[1]["rendered"] == "<|im_start|>assistant\nyes<|im_end|>\n" and got[1]["start"] == len(got[0]["rendered"])
    assert chat.render(df.limit(0)).count() == 0


def test_chat_equals_sql(spark, sf_dir):
    got = {tuple(r) for r in chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{sf_dir}/conversations.parquet'")
    assert got == set(con.execute(queries.OP5_SQL).fetchall())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered(name):
    assert name in __spark_entry__.queries()
