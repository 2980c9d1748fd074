"""The whole search, embeddings, settings and the command line."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.__main__ import main
from lexmill.config import ChunkConfig, SearchConfig, from_mapping
from lexmill.functions.unicode import matching_ratio, nfkc
from lexmill.operators import embedding as E
from lexmill.plans.search_api import cached_answers, search


@pytest.fixture(scope="module")
def index(spark):
    texts = ["firewall rules block traffic", "phishing mail attack", "sql injection risk", "model training data", "patch policy guide", "mail filter rules"] * 4
    names = ["NIST_SP", "MITRE", "OWASP", "NIST_AI", "NIST_SP", "OWASP"] * 4
    df = spark.createDataFrame([(i, i // 3, i % 3, names[i], t + f" number{i}") for i, t in enumerate(texts)], "id long, doc_id long, page int, collection string, content string")
    return df.join(E.embedded(df, "id", "content").withColumnRenamed("vector", "v"), "id")


def test_search(spark, index):
    q = spark.createDataFrame([(1, "mail attack", "general"), (2, "mail rules", "security"), (3, " ", "general")], "query_id long, text string, agent string")
    q = q.join(E.embedded(q, "query_id", "text").withColumnRenamed("vector", "qv"), "query_id")
    rows = search(q, index, 3).orderBy("query_id", "place").collect()
    assert {r["query_id"] for r in rows} == {1, 2}
    assert [r["place"] for r in rows if r["query_id"] == 1] == [1, 2, 3]
    assert {r["collection"] for r in rows if r["query_id"] == 2} == {"OWASP"}
    assert "MAIL" in rows[0]["highlight"] and rows[0]["matched_terms"] == 2
    only = search(q, index, 3, rerank=False, filters=F.col("doc_id") < 2).collect()
    assert only and all(r["doc_id"] < 2 for r in only)
    assert search(q, index.where("id < 0"), 3).collect() == []


def test_hashed_vectors(spark):
    v = E.hashed_model(64)(["a b c", "a b c", ""])
    assert np.allclose(v[0], v[1]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[2].any()


def test_expansion(spark):
    q = spark.createDataFrame([(1, ["car", "red"])], "query_id long, terms array<string>")
    s = spark.createDataFrame([("car", "auto")], "term string, synonym string")
    assert E.expanded_terms(q, s).first()["terms"] == ["auto", "car", "red"]
    texts = spark.createDataFrame([(1, "why?")], "query_id long, text string")
    assert sorted(r["text"] for r in E.with_hypothetical(texts, "So {} is").collect()) == ["So why? is", "why?"]


def test_time_to_live(spark):
    a = spark.createDataFrame([("k", 100, "old"), ("k", 200, "new")], "key string, ts long, answer string").withColumn("ts", F.timestamp_seconds("ts"))
    asked = spark.createDataFrame([("k", 3700), ("k", 3900)], "key string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    assert [r["answer"] for r in cached_answers(a, asked).collect()] == ["new"]


def test_unicode(spark):
    df = spark.createDataFrame([("ﬁ²", "fi2"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(nfkc("a")).collect()] == ["fi2", None]
    assert [r[0] for r in df.select(matching_ratio(nfkc("a"), "b")).collect()] == [1.0, 1.0]


def test_settings():
    assert from_mapping(ChunkConfig, {"target": 150}).target == 150
    for bad in ({"target": 900}, {"overlap": 1.0}, {"nope": 1}):
        with pytest.raises(ValueError):
            from_mapping(ChunkConfig, bad)
    with pytest.raises(ValueError):
        SearchConfig(alpha=2)


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "hybrid_search" in capsys.readouterr().out
    out = str(tmp_path / "o")
    for extra in ([], ["--skip-existing"]):
        assert main(["run", "exact_dups", "--data", "/root/testdata/sf0.001", "--out", out, *extra]) == 0
    assert spark.read.parquet(out).columns == ["doc_id", "canonical", "copies"]
