"""Records, refinement, joins in time, packing and cleaning against plain Python; files and streams."""

from __future__ import annotations

import json
import random
import re
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexmill.config import ChunkConfig
from lexmill.functions import text as T
from lexmill.operators import chunking as K
from lexmill.operators import layout as L
from lexmill.operators import records as R
from lexmill.operators import refine as N
from lexmill.operators import search as S
from lexmill.operators import temporal as J
from lexmill.plans import search_api
from lexmill.sources import readers
from lexmill.streaming import incremental as I

SF = "/root/testdata/sf0.001"


def texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def tokens(t):
    return max(1, int((len(t.split()) * 1.3 + len(t) / 4) / 2)) if t else 0


def test_packing_against_a_loop(spark):
    blocks = L.with_sections(L.blocks_of(texts(spark))).cache()
    rows = sorted(blocks.collect(), key=lambda r: (r["doc_id"], r["block_idx"]))
    want = {}
    for doc in {r["doc_id"] for r in rows}:
        out, buf, n, last = [], [], 0, ""
        for r in (r for r in rows if r["doc_id"] == doc):
            section = r["section_title"] or ""
            if buf and ((last != "" and section != last) or r["is_heading"] or (n + r["tokens"] > 256 and n >= 100)):
                out.append(buf)
                buf, n = [], 0
            buf, n, last = [*buf, r], n + r["tokens"], section
            if n >= 200 and (n >= 200 * 1.1 or n >= 256 * 0.9):
                out.append(buf)
                buf, n = [], 0
        out += [buf] if buf else []
        for i, c in enumerate(out):
            plain = not any(b["is_heading"] for b in c)
            score = 1.0 if len(c) < 2 else 0.5 * (len({b["section_title"] or "" for b in c}) == 1) + 0.3 + 0.2 * plain
            want[doc, i] = ("\n\n".join(b["text"] for b in c), sum(b["tokens"] for b in c), round(score, 1))
    chunks = K.pack_by_structure(blocks).cache()
    got = {(r["doc_id"], r["chunk_id"]): (r["content"], r["chunk_tokens"], r["block_cohesion"]) for r in chunks.collect()}
    assert got == want
    before = {}
    for (doc, i), (content, n, _) in sorted(want.items()):
        tail, room, used = [], int(n * 0.18), 0
        for s in reversed(re.split(r"(?<=[.!?])\s+", before.get(doc, ""))):
            if used + tokens(s) > room:
                break
            tail, used = [s, *tail], used + tokens(s)
        t = " ".join(x for x in tail if x)
        before[doc] = f"{t}\n\n{content}" if t else content
        want[doc, i] = (before[doc], bool(t))
    got = {(r["doc_id"], r["chunk_id"]): (r["content"], r["overlap_applied"]) for r in K.with_overlap(chunks).collect()}
    assert got == want


def test_cohesion(spark):
    rows = [(["a"], ["x"], [True]), (["a", "a"], ["x", "y"], [False, False]), (["a", "b"], ["x", "y"], [False, False]), (["a", "b", "b"], ["x", "y", "z"], [True, False, False])]
    df = spark.createDataFrame(rows, "s array<string>, c array<string>, h array<boolean>")
    assert [r[0] for r in df.select(K.cohesion(F.col("s"), F.col("c"), F.col("h"))).collect()] == [1.0, 1.0, 0.5, 0.0]


def test_line_cleaning_against_a_loop(spark):
    odd = ["Page 3", "Contents ....", "Chapter one 5", "a very long line that ends the contents here", "1 / 7", "ab", "x  ....  y", "References", "[1] z", "Copyright me", "- 4 -"]
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choices([*odd, "plain words here", "more plain words, seven of them in all"], k=12))) for i in range(60)]

    def cleaned(text):
        toc, out = False, []
        for line in text.split("\n"):
            starts = re.search(T.CONTENTS_HEADS, line) is not None
            toc = starts or (toc and not (len(line.split()) > 5 and not re.search(r"\d+\s*$", line)))
            if toc or any(re.search(p, line) for p in T.PAGE_LINES):
                continue
            for p in T.NOISE:
                line = re.sub(p, "", line)
            out.append(" ".join(line.split()))
        return "\n".join(x for x in out if len(x) > 2)

    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r[0]: r[1] for r in df.select("doc_id", T.cleaned_lines(F.col("text"))).collect()} == {i: cleaned(t) for i, t in rows}


def test_diversity_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(q, k + 1, 100 * q + k, rng.randrange(6), rng.randrange(8), [rng.gauss(0, 1), rng.gauss(0, 1)]) for q in range(12) for k in range(16)]
    df = spark.createDataFrame(rows, "query_id int, rank int, id long, doc_id long, page int, v array<float>")
    cos = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / ((a[0] ** 2 + a[1] ** 2) * (b[0] ** 2 + b[1] ** 2)) ** 0.5
    want = set()
    for q in range(12):
        kept = []
        for r in (r for r in rows if r[0] == q):
            if not any((o[3] == r[3] and abs(o[4] - r[4]) <= 2) or cos(o[5], r[5]) > 0.9 for o in kept):
                kept.append(r)
        want |= {(q, i + 1, r[2]) for i, r in enumerate(kept[:5])}
    assert {(r["query_id"], r["place"], r["id"]) for r in S.diversified(df, 5).collect()} == want


def test_token_windows_against_a_loop(spark):
    docs = texts(spark).limit(40).cache()
    want = set()
    for r in docs.collect():
        w = r["text"].split()
        cost = [Fraction(13, 20) + Fraction(len(x) + 1, 8) for x in w]
        at = k = 0
        while at < len(w):
            end, n = at, 0
            while end < len(w) and (n + cost[end] <= 150 or end == at):
                n += cost[end]
                end += 1
            want.add((r["doc_id"], k, at, end))
            if end >= len(w):
                break
            nxt, n = at, 0
            while n + cost[nxt] <= 30:
                n += cost[nxt]
                nxt += 1
            at, k = max(at + 1, nxt), k + 1
    assert {tuple(r) for r in K.token_windows(docs).collect()} == want


def test_oversize_split(spark):
    rng = random.Random(7)
    sentence = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n)) + "."
    rows = [(1, 0, "short"), (1, 1, "\n\n".join(" ".join(sentence(12) for _ in range(6)) for _ in range(8))), (1, 2, " ".join(sentence(15) for _ in range(40))), (2, 0, sentence(900)), (3, 0, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id int, block_idx int, text string")
    got = sorted(N.split_oversize(df).collect(), key=lambda r: (r["doc_id"], r["block_idx"], r["piece"]))
    for doc, block, text in rows:
        own = [r for r in got if (r["doc_id"], r["block_idx"]) == (doc, block)]
        assert " ".join(r["text"] for r in own).split() == text.split()
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["tokens"] <= 256 for r in own) or len(text.split()) == 1
        assert all(r["is_split"] == (len(own) > 1) for r in own)
    assert all("\n\n" in r["text"] for r in got if (r["doc_id"], r["block_idx"]) == (1, 1))


def test_semantic_refinement(spark):
    topic = lambda w, n: " ".join(f"{w}{i % 7}" for i in range(n))
    text = topic("alpha", 400) + " " + topic("beta", 400)
    cuts = N.boundaries(text, N.hashed_model(), ChunkConfig())
    total = N.token_count(text)
    assert cuts and min(abs(c - total / 2) for c in cuts) < 120
    pieces = N.refined_texts(text, N.hashed_model(), ChunkConfig())
    assert " ".join(pieces).split() == text.split() and all(N.token_count(p) <= 270 for p in pieces)
    assert N.refined_texts("few words", N.hashed_model(), ChunkConfig()) == ["few words"] and N.refined_texts(" ", N.hashed_model(), ChunkConfig()) == []
    df = spark.createDataFrame([(1, text, True), (2, text, False), (3, None, True)], "doc_id long, text string, breakable boolean")
    n = {r["doc_id"]: r["count"] for r in N.refined(df).groupBy("doc_id").count().collect()}
    assert n == {1: len(pieces), 2: 1}
    assert N.context_factor("```\n| | | |") == pytest.approx(0.3 * 0.4) and N.context_factor("# T\n\nx") == pytest.approx(1.4 * 1.05)


def test_section_paths(spark):
    rows = [(1, i, t, True, level) for i, (t, level) in enumerate([("A", 1), ("B", 2), ("C", 3), ("D", 2), ("E", 1), ("F", 3), ("G", 2)])]
    df = spark.createDataFrame(rows, "doc_id int, block_idx int, text string, is_heading boolean, level int")
    assert [r["section_path"] for r in N.section_paths(df).orderBy("block_idx").collect()] == ["A", "A > B", "A > B > C", "A > D", "E", "E > F", "E > G"]


def test_metadata(spark):
    df = spark.createDataFrame([("a", 5, 50.0), ("b", -1, 101.0), (None, None, None)], "source_id string, words int, quality_score double")
    fields = {c: F.col(c) for c in df.columns}
    got = [r[0] for r in df.select(R.metadata_errors(fields)).collect()]
    rest = [f"missing {c}" for c in R.REQUIRED if c not in fields]
    assert got[0] == rest and got[1] == [*rest, "words below 0", "quality_score not in 0 to 100"] and set(got[2]) == {f"missing {c}" for c in R.REQUIRED}
    whole = {c: F.lit(None).cast("string") for c in R.REQUIRED} | fields | {"special_identifiers": F.array(*[F.lit(str(i)) for i in range(12)])}
    ok = df.where("quality_score = 50").select(R.metadata_record(whole).alias("m")).first()["m"]
    assert len(ok["special_identifiers"]) == 10 and ok["words"] == 5
    with pytest.raises(PySparkException):
        df.select(R.metadata_record(whole)).collect()
    merged = spark.range(1).select(R.with_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))).first()[0]
    assert merged == {"a": "1", "b": "3"}


def test_newest_and_kept(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, None), (2, None, "c")], "k int, n int, r string")
    assert {tuple(r) for r in R.newest(df, ["k"], "n").collect()} == {(1, 7, "b"), (2, 1, None)}
    assert {tuple(r) for r in R.kept_files(df, df.where("k = 1"), "k").collect()} == {(2, 1, None), (2, None, "c")}


def test_as_of_and_within(spark):
    rng = random.Random(11)
    left = [(i, rng.randrange(3), rng.randrange(100)) for i in range(60)]
    right = [(i, rng.randrange(3), rng.randrange(100)) for i in range(60)]
    a, b = (spark.createDataFrame([(i, u, t) for i, u, t in x], "id int, u int, t int").select("id", "u", F.timestamp_seconds("t").alias("ts")) for x in (left, right))
    got = {r["id"]: r["last_id"] for r in J.as_of(a, b, "u", "ts", "id").collect()}
    for i, u, t in left:
        best = max(((s, j) for j, v, s in right if v == u and s <= t), default=(0, None))
        assert got[i] == best[1]
    pairs = {(r["l"]["id"], r["r"]["id"]) for r in J.within(a, b, "u", "ts", 7).collect()}
    assert pairs == {(i, j) for i, u, t in left for j, v, s in right if u == v and abs(s - t) <= 7}


def test_cached_answers(spark):
    a = spark.createDataFrame([("q", 100, "old"), ("q", 200, "new"), ("q", 900, "later")], "key string, t int, answer string").select("key", F.timestamp_seconds("t").alias("ts"), "answer")
    q = spark.createDataFrame([("q", 250, 1), ("q", 50, 2), ("q", 800, 3)], "key string, t int, id int").select("key", F.timestamp_seconds("t").alias("ts"), "id")
    assert {r["id"]: r["answer"] for r in search_api.cached_answers(a, q, 500).collect()} == {1: "new"}


def test_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text(json.dumps({"text": "x" * 30}) + "\n")
    (tmp_path / "p" / "b.jsonl").write_text("")
    (tmp_path / "p" / "c.jsonl").write_text(json.dumps({"text": "  x "}) + "\n")
    got = {r["file"][-7:]: (r["pages"], r["chars"], r["reason"]) for r in readers.json_file_checks(spark, str(tmp_path / "p")).collect()}
    assert got == {"a.jsonl": (1, 30, None), "b.jsonl": (0, 0, "no pages"), "c.jsonl": (1, 1, "too little text")}
    rows = "".join(f'{i};"body\n{i}";r\n' if i % 4 else f"{i};;r\n" for i in range(20))
    (tmp_path / "q.csv").write_text("Titulo;Cuerpo;Respuesta\n" + rows)
    got = readers.questions(spark, str(tmp_path / "q.csv"), start=3, n=6).collect()
    assert [(r["Titulo"], r["question"]) for r in got] == [(str(i), f"{i}\n\nbody\n{i}") for i in (3, 5, 6, 7)]
    assert readers.questions(spark, str(tmp_path / "q.csv")).count() == 15


def test_stream_upsert_over_batches(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, rng.randrange(40), rng.randrange(1000)) for i in range(300)]
    source = str(tmp_path / "in")
    for k in range(3):
        part = spark.createDataFrame(rows[100 * k : 100 * k + 100], "id int, key int, n int")
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(source)
        I.upsert(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["key"], ["n", "id"], buckets=4).awaitTermination()
        want = {}
        for i, key, n in rows[: 100 * k + 100]:
            want[key] = max(want.get(key, (-1, -1)), (n, i))
        assert {r["key"]: (r["n"], r["id"]) for r in I.current(spark, str(tmp_path / "out")).collect()} == want
