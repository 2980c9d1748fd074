"""What the findings of round 3 named: results on odd rows, and steps that must not grow faster than their input."""

from __future__ import annotations

import math
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking as K
from lexmill.operators import embedding as E
from lexmill.operators import keywords as W
from lexmill.operators import metrics as M
from lexmill.operators import refine as N
from lexmill.operators import search as S
from lexmill.operators import temporal as J
from lexmill.plans import registry


def against_sql(spark, tmp_path, name: str, **tables) -> list[tuple]:
    """The rows of a query over small tables, which must be those of its SQL; tables are (rows, schema)."""
    c = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{table}.parquet")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    norm = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = c.sql(registry.oracle_sql()[name])
    want = sorted(tuple(norm(dict(zip(r.columns, x, strict=True))[c]) for c in sorted(df.columns)) for x in r.fetchall())
    assert got == want
    return got


DOCS = "doc_id long, text string"


def test_f1_long_words_are_split_too(spark, tmp_path):
    digests = [f"{i:040x}" for i in range(300)]
    texts = [" ".join(digests), " ".join("y" * 1200 for _ in range(5)), "z" * 9000, "a " + "z" * 9000 + " b", "short", " ".join(digests[:70]) + "\n" + "w " * 900]
    got = against_sql(spark, tmp_path, "oversize_split", documents=(list(enumerate(texts)), DOCS))
    assert len(got) == len(texts)


def nearest_by_sorting(queries, rows, k, by=lambda r: ()):
    """(query_id, by, rank, id) by sorting all pairs: nine digits of the cosine, then the id; NaN first, none last."""
    out = []
    for name, q in queries:
        groups = {}
        for i, v, *rest in rows:
            s = -math.inf
            if q is not None and v is not None and len(q) == len(v) and None not in v:
                dot, n, m = (sum(x * y for x, y in zip(a, b, strict=True)) for a, b in ((q, v), (q, q), (v, v)))
                s = -math.inf if n * m == 0 else math.inf if math.isnan(dot / math.sqrt(n * m)) else math.floor(dot / math.sqrt(n * m) * 1e9 + 0.5)
            groups.setdefault(by((i, v, *rest)), []).append((-s, i))
        out += [(name, g, rank, i) for g, all_ in groups.items() for rank, (_, i) in enumerate(sorted(all_)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2_000, 5])
def test_f2_nearest_equals_sorting_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(S, "QUERY_BLOCK", block)
    rng = random.Random(3)
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    vector = lambda: [f32(rng.gauss(0, 1)) for _ in range(4)]
    common, rows = vector(), []
    for i in range(3_000):
        v = vector() if i % 3 else [f32(x * (1 + i % 5)) for x in common]
        v = {7: None, 8: [0.0] * 4, 9: [1.0, None, 0.0, 0.0], 10: [1.0, 2.0], 11: [math.inf, 1.0, 0.0, 0.0], 12: [math.nan] * 4}.get(i, v)
        rows.append((i * 7919 % 3_001, v, f"g{i % 4}" if i % 100 else "rare"))
    queries = [(i, vector()) for i in range(12)] + [(20, common), (21, None), (22, [0.0] * 4), (23, [f32(-x) for x in common])]
    q = spark.createDataFrame(queries, "query_id long, qv array<float>")
    r = spark.createDataFrame(rows, "id long, v array<float>, g string").repartition(3)
    got = sorted((x["query_id"], (), x["rank"], x["id"]) for x in S.nearest(q, r, 10).collect())
    assert got == nearest_by_sorting(queries, rows, 10)
    got = sorted((x["query_id"], (x["g"],), x["rank"], x["id"]) for x in S.nearest(q, r, 3, ("g",)).collect())
    assert got == nearest_by_sorting(queries, rows, 3, lambda x: (x[2],))
    assert S.nearest(q.where("query_id < 0"), r, 3).collect() == [] == S.nearest(q, r.where("id < 0"), 3).collect()


def test_f6_agents_ask_their_collections(spark):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(3)]
    rows = [(i, vector(), S.COLLECTIONS[i % 10] if i % 13 else None) for i in range(700)]
    agents = ["Policy", "research", "general", None, "unknown"]
    queries = [(i, vector(), agents[i % 5]) for i in range(10)]
    got = S.nearest(spark.createDataFrame(queries, "query_id long, qv array<double>, agent string"), spark.createDataFrame(rows, "id long, v array<double>, collection string"), 5)
    want = []
    for i, v, a in queries:
        own = S.ROUTES.get((a or "").lower())
        want += [(n, rank, r) for n, _, rank, r in nearest_by_sorting([(i, v)], [r for r in rows if own is None or r[2] in own], 5)]
    assert sorted((x["query_id"], x["rank"], x["id"]) for x in got.collect()) == sorted(want)


def test_f2_pairs_are_not_rows_of_the_plan(spark):
    """No product of rows and queries is made row by row: it took all the time."""
    for name in ("cosine_topk", "topk_per_collection", "search_quality", "softmax_rank", "routed_search", "diversify"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Cross" not in plan and "NestedLoop" not in plan, name


def test_f10_words_of_overlapping_windows_are_hashed_once():
    rng = random.Random(1)
    w = [f"Wort{rng.randrange(60)}" for _ in range(400)] + ["ΟΔΟΣ", "İx"]
    spans = [(i, min(len(w), i + 90)) for i in range(0, len(w), 25)]
    model = E.hashed_model(64)
    assert (model.windows(w, spans) == model([" ".join(w[a:b]) for a, b in spans])).all()


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f13_f16_words_are_not_searched_as_patterns(spark):
    texts = ["Tactic", "an ATTACK or att&ck", "t1234", "CVE-2021-12345", "common vulnerabilities", "www.a", "", None, "ioc m0001 (group)", "a" * 32, "x T1059.001 y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    low = F.lower("text")
    for p in (p for ps in T.DOCUMENT_TYPES.values() for p in ps):
        assert df.where(~T.matches(low, p).eqNullSafe(low.rlike(p))).count() == 0, p
    known = df.select("text", T.has_identifier(F.col("text")).alias("k")).collect()
    assert {r["text"] for r in known if r["k"]} == {"t1234", "CVE-2021-12345", "ioc m0001 (group)", "a" * 32, "x T1059.001 y"}
    plan = plan_of(df.select(T.text_quality(F.col("text"))))
    assert "Contains(" in plan or "contains(" in plan
    assert plan_of(df.select(M.chunk_flags(F.col("text"), ("the",)))).count("(\\S+)") <= 2


def test_f15_only_texts_over_the_limit_go_through_python(spark):
    blocks = spark.createDataFrame([(1, 0, "short"), (1, 1, "word " * 900)], "doc_id long, block_idx int, text string")
    df = N.split_oversize(blocks)
    assert "ArrowEvalPython" in plan_of(df) and [r["is_split"] for r in df.where("block_idx = 0").collect()] == [False]


def test_f17_the_carried_sentences_are_found_once(spark):
    chunks = spark.createDataFrame([(1, i, f"One {i}. Two {i}. Three {i}.", 40) for i in range(4)], "doc_id long, chunk_id int, content string, chunk_tokens int")
    assert plan_of(K.with_overlap(chunks)).count("(?<=[.!?])") == 1


def test_f8_f14_f18_words_of_documents_are_not_rows_of_the_plan(spark):
    """Every word was a row that was joined to the terms, and in F8 every pair of query and document too."""
    for name in ("hybrid_search", "bm25_corpus"):
        plan = plan_of(registry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "MapInArrow" in plan and "Generate explode" not in plan and "Cross" not in plan, name
    plan = plan_of(registry.queries()["suggestions"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in plan and "Generate explode" not in plan


ODD = [(1, "alpha beta alpha"), (2, None), (3, ""), (4, "gamma"), (5, "alpha beta alpha"), (6, "BETA x beta"), (7, "delta " * 50), (9, "alpha"), (10, "alpha gamma"), (12, "beta gamma gamma")]
ITEMS = [(1, "alpha gamma"), (2, "beta"), (3, "nothing of it"), (4, "alpha alpha BETA delta")]


@pytest.mark.parametrize("block", [250, 2])
@pytest.mark.parametrize("name", ["hybrid_search", "bm25_corpus", "suggestions"])
def test_f8_f14_f18_odd_documents(spark, tmp_path, monkeypatch, name, block):
    monkeypatch.setattr(W, "QUERY_BLOCK", block)
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(9)]
    got = against_sql(spark, tmp_path, name, documents=(ODD, DOCS), benchmark=(ITEMS, "item_id long, text string"), embeddings=(vectors, "vec_id long, embedding array<float>, label int"))
    assert got


def test_f11_search_embeds_no_row_twice(spark):
    plan = plan_of(registry.queries()["full_search"](spark, "/root/testdata/sf0.001"))
    assert "Generate explode" not in plan and plan.count("MapInPandas") <= 2  # the queries' vectors only


def test_f12_ranks_tell_what_exact_percentiles_do(spark, tmp_path):
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(30)), m / 2) for g in range(40) for m in [rng.randrange(60)] for _ in range(rng.choice([1, 2, 3, 7, 50, 101]))]
    df = spark.createDataFrame(rows, "g int, x double, m double")
    exact = {r["g"]: r for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.49), F.lit(0.51))).alias("q"), F.first("m").alias("m")).collect()}
    got = J.ranks_of(df, "g", "x", "m").select("g", J.at_least(0.49).alias("a"), J.at_most(0.51).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(exact[r["g"]]["m"] >= exact[r["g"]]["q"][0], exact[r["g"]]["m"] <= exact[r["g"]]["q"][1]) for r in got]
    assert len({(r["a"], r["b"]) for r in got}) == 3
    items = [(f"{'AB'[i % 2]}" if i % 7 else None, i % 90, 1.0 * (i * 37 % 1000)) for i in range(3_000)]
    against_sql(spark, tmp_path, "approximate_counts", lineitem=(items, "l_returnflag string, l_partkey long, l_extendedprice double"))
    plan = plan_of(registry.queries()["approximate_counts"](spark, "/root/testdata/sf0.001"))
    assert "percentile(" not in plan  # it kept every value of a group in one task


def test_f9_shingles_are_counted_where_they_are(spark, tmp_path):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 80]))] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.01 else "changed" for w in rng.choice(base)) for _ in range(60)] + ["", None, "a b", "A B c", "a b c", "a b  c"]
    got = against_sql(spark, tmp_path, "near_dups", documents=(list(enumerate(texts)), DOCS))
    assert got
    # Every shingle went through a join with its count, and those that occur once were sorted with the others.
    assert "Window [count(1)" in plan_of(registry.queries()["near_dups"](spark, str(tmp_path)))
