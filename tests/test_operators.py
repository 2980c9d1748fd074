"""Layout, chunking, search, dedup, datasets, metrics, sources, sinks and streams on small inputs."""

from __future__ import annotations

import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from lexmill.functions import vectors as V
from lexmill.operators import catalog as C
from lexmill.operators import chunking as K
from lexmill.operators import dataset as D
from lexmill.operators import dedup as U
from lexmill.operators import layout as L
from lexmill.operators import metrics as M
from lexmill.operators import search as S
from lexmill.sources import readers as R
from lexmill.sources import writers as W
from lexmill.streaming import incremental as I


def docs(spark, *texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")


def test_repeated_edges_survive_a_trailing_blank_line(spark):
    pages = spark.createDataFrame([(1, "HEAD\nbody one\nfoot\n"), (1, "HEAD\nbody two\nfoot"), (1, "HEAD\nbody\nother")], "s int, text string")
    edges = L.repeated_edges(pages, "s")
    assert {(r["edge"], r["line"]) for r in edges.collect()} == {("first", "HEAD"), ("last", "foot")}
    assert sorted(r["text"] for r in L.without_edges(pages, "s", edges).collect()) == ["body\nother", "body one", "body two"]


def test_toc_path(spark):
    toc = [(1, "A", 1), (2, "B", 2), (2, "C", 4), (1, "D", 9)]
    df = spark.createDataFrame([(toc, p) for p in (0, 1, 3, 5, 9)], "toc array<struct<level:int,title:string,page:int>>, p int")
    assert [r[0] for r in df.select(L.toc_path(F.col("toc"), F.col("p"))).collect()] == [[], ["A"], ["A", "B"], ["A", "C"], ["D"]]


def test_packing_keeps_text_and_order(spark):
    text = "\n".join(f"Heading {i}\n" + "\n".join(f"This is line {j} of the section and it has quite a few more words than eight in it." for j in range(i)) for i in range(1, 20))
    blocks = L.with_sections(L.blocks_of(docs(spark, text))).cache()
    for n in (1, 16):
        chunks = K.pack_by_structure(blocks.repartition(n)).orderBy("chunk_id").collect()
        assert "\n\n".join(c["content"] for c in chunks).replace("\n\n", "\n") == text
        assert [c["chunk_id"] for c in chunks] == list(range(len(chunks)))
        assert all(c["chunk_tokens"] <= 256 or c["source_blocks"] == 1 for c in chunks)


def test_overlap(spark):
    chunks = spark.createDataFrame([(1, 0, "One two. Three four.", 6), (1, 1, "word " * 60, 90)], "doc_id long, chunk_id int, content string, chunk_tokens int")
    got = K.with_overlap(chunks).orderBy("chunk_id").collect()
    assert not got[0]["overlap_applied"] and got[1]["overlap_applied"]
    assert got[1]["content"].startswith("One two. Three four.\n\nword")


def test_cuts():
    assert K.even_cuts([], 1000, 100, 256, 200) == [200, 400, 600, 800]
    assert K.even_cuts([50, 300], 400, 100, 256, 200) == [200, 300]
    assert K.spaced_peaks([(10, 3.0), (12, 5.0), (40, 1.0)], 20) == [12, 40]
    assert K.text_at_cuts("aa bb cc dd", [2], 4) == ["aa bb cc", "dd"]


def test_windows_cover_all_words(spark):
    rows = K.token_windows(docs(spark, "some words " * 400, "", None)).orderBy("doc_id", "window_id").collect()
    assert {r["doc_id"] for r in rows} == {0}
    assert rows[0]["start_word"] == 0 and rows[-1]["end_word"] == 800
    assert all(b["start_word"] <= a["end_word"] for a, b in zip(rows, rows[1:], strict=False))


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.similarity_of_distance(F.lit(-0.1)), V.similarity_of_distance(F.lit(0.3))).first()
    assert math.isclose(r[0], 0.5**0.5) and r[1] is None and r[2] == 0 and math.isclose(r[3], 0.7)
    p = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "g int, s double").select(V.softmax(F.col("s"), "g").alias("p"), "g")
    assert {r["g"]: round(r["t"], 9) for r in p.groupBy("g").agg(F.sum("p").alias("t")).collect()} == {1: 1.0, 2: 1.0}


def test_keyword_score_falls_with_hits(spark):
    df = spark.createDataFrame([(["a"], ["b"]), (["a"], ["a"]), (["a"], ["a"] * 5)], "q array<string>, t array<string>")
    got = [round(r[0], 3) for r in df.select(V.keyword_score_compat(F.col("q"), F.col("t"))).collect()]
    assert got == [0.5, 0.432, 0.371]


def test_search_stages(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)], "id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, qv array<double>")
    got = [(r["query_id"], r["id"]) for r in S.nearest(q, rows, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 0), (1, 1), (2, 7), (2, 6)]
    ranked = spark.createDataFrame([(1, i + 1, i, 0 if i < 2 else i, 1, [1.0, i * 1.0]) for i in range(5)], "query_id long, rank int, id long, doc_id long, page int, v array<float>")
    assert [r["id"] for r in S.diversified(ranked, 3, most=0.95).orderBy("place").collect()] == [0, 2]
    hit = docs(spark, "x " * 60 + "needle here").select(S.highlighted(F.col("text"), F.array(F.lit("needle"))).alias("h")).first()["h"]
    assert "NEEDLE" in hit and len(hit.split()) == 50


def test_near_duplicates_against_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, base.replace("w50", "x"), base + " tail", "other " + " ".join(f"v{i}" for i in range(50)), "", "a b"]
    got = {(r["a"], r["b"]) for r in U.near_duplicates(docs(spark, *texts)).collect()}
    sets = [{tuple(t.lower().split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {(i, j) for j in range(6) for i in range(j) if sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j])}
    assert got == want


def test_uuid_is_version_5(spark):
    got = spark.range(1).select(U.deterministic_uuid(F.lit("chunk"), F.lit(7), F.lit("MITRE"))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:7:MITRE"))


def test_dataset(spark):
    assert docs(spark, "few words").select(D.quality_text(F.col("text"))).first()[0] is None
    long = docs(spark, "w " * 3000).select(D.quality_text(F.col("text"))).first()[0]
    assert len(long.split()) == 2000
    got = docs(spark, "body").select(D.with_context(F.col("text"), Source=F.lit("s"), Page=F.lit(None))).first()[0]
    assert got == "Source: s\n\nbody"
    share = spark.range(5000).select(D.split_of(F.col("id")).alias("s")).where("s = 'validation'").count() / 5000
    assert 0.08 < share < 0.12


def test_metrics(spark):
    assert M.bleu("a b c d e", "a b c d e") == 1.0 and M.bleu("a b", "c d") == 0.0
    assert M.rouge_l("a b c", "a x c") == pytest.approx(2 / 3)
    flags = docs(spark, "").select(M.chunk_flags(F.col("text"), ("the",))).first()[0]
    assert flags == ["empty", "too_short"]
    p = spark.createDataFrame([(1.0, 1), (2.0, 3)], "l double, n int").agg(M.weighted_perplexity(F.col("l"), F.col("n"))).first()[0]
    assert p == pytest.approx(math.exp(7 / 4))
    j = docs(spark, "DECISION: approve\nRELEVANCE: 8\nGROUNDEDNESS: 3").select(*[c.alias(k) for k, c in M.judged(F.col("text")).items()]).first()
    assert (j["decision"], j["relevance"], j["groundedness"], j["completeness"]) == ("APPROVE", 8, 3, None)


def test_catalogs(spark):
    files = spark.createDataFrame([("a", "x", 5, 1), ("s/a", "x", 5, 2), ("b", "y", 1, 1)], "path string, name string, size long, depth int")
    kept = {r["path"]: r["keep"] for r in C.file_duplicates(files).collect()}
    assert kept == {"a": False, "s/a": True}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.pages.jsonl").write_text('{"text": "long enough text of a page"}\n\nnot json\n')
    (tmp_path / "j" / "b.pages.jsonl").write_text('{"text": "tiny"}\n')
    assert R.json_lines(spark, str(tmp_path / "j"), "text string").count() == 2
    reasons = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in R.json_file_checks(spark, str(tmp_path / "j")).collect()}
    assert reasons == {"a.pages.jsonl": None, "b.pages.jsonl": "too little text"}
    (tmp_path / "q.csv").write_text("Titulo;Cuerpo\nt1;b1\n;b2\nt3;\"b\n3\"\n")
    assert [r["question"] for r in R.questions(spark, str(tmp_path / "q.csv")).collect()] == ["t1\n\nb1", "t3\n\nb\n3"]
    assert [r["question"] for r in R.questions(spark, str(tmp_path / "q.csv"), start=2, n=1).collect()] == ["t3\n\nb\n3"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "u.txt").write_bytes("ñ".encode())
    (tmp_path / "t" / "l.txt").write_bytes("ñ".encode("latin-1"))
    files = R.raw_texts(spark, str(tmp_path / "t"))
    assert {(r["text"], r["encoding"]) for r in files.collect()} == {("ñ", "utf-8"), ("ñ", "latin-1")}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "u_metadata.json").write_text(json.dumps({"tool_id": "1", "title": "T"}))
    sides = R.json_lines(spark, str(tmp_path / "m"), R.SIDECAR)
    assert {r["title"] for r in R.with_sidecars(files, sides).collect()} == {"T", None}
    W.csv(docs(spark, "a;b"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    old, new = docs(spark, "old0", "old1"), spark.createDataFrame([(1, "new1")], "doc_id long, text string")
    assert sorted(r["text"] for r in W.upserted(old, new, ["doc_id"], "text").collect()) == ["new1", "old0"]


def test_items(spark):
    row = ("u1", "h1", "Network Security", [("dc.subject", "PKI")], [("f.pdf", "b", "application/pdf", "/r", 9), ("f.txt", "c", "text/plain", "/t", 1)])
    items = spark.createDataFrame([row, row], R.ITEM)
    assert R.first_items(items).count() == 1
    assert R.keyword_items(items, ["pki"]).count() == 2 and R.keyword_items(items, ["zzz"]).count() == 0
    assert [r["bytes"] for r in R.pdf_links(R.first_items(items)).collect()] == [9]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    docs(spark, "some plain words", "more words here").write.json(str(src))
    stream = I.cleaned(I.read(spark, str(src), "doc_id long, text string"))
    for _ in range(2):  # a second run finds nothing new and changes nothing
        q = I.upsert(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["doc_id"], ["text"])
        q.awaitTermination(120)
    assert I.current(spark, str(tmp_path / "out")).count() == 2
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:20:00", "a", 2.0), (1, "2024-01-02 00:00:00", "a", 4.0)], "user_id long, ts string, event_type string, value double")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["total"] for r in I.windowed(events, "1 day").collect()) == [3.0, 4.0]
    assert sorted(r["n"] for r in I.sessions(events, "1 hour").collect()) == [1, 2]
