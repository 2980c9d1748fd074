"""Every stage of the pipeline on its own input, against a brute-force version; odd rows, empty tables."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm import op10_toxicity

SF = "/root/testdata/sf0.001"


def near_duplicates(rows):
    """One row of each group linked by five-word sets of Jaccard 0.8 or more: the one with the smallest doc_id."""
    sets = []
    for _, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            o, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if u and 100 * o >= 80 * u and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    return [r for k, r in enumerate(rows) if not sets[k] or r[0] == min(rows[j][0] for j in range(len(rows)) if group[j] == group[k])]


def repeated_passages(rows, n=50):
    """Texts without the words of 50-word windows that a smaller doc_id has too."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                keep[k : k + n] = [False] * n
        out.append((i, t if all(keep) else b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "packing"]
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    model = op10_toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = op10_toxicity.score(model, [t for _, t in pairs(docs)])
    want = {
        "toxicity": lambda rows: [r for r, s in zip(rows, scores, strict=True) if s < 0.5],
        "near_duplicates": near_duplicates,
        "repeated_passages": repeated_passages,
    }
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = pairs(docs)
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert Counter(pairs(docs)) == Counter(want[name](before)), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).cache()
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], {})[r["start"]] = (r["length"], r["ids_crc32"])
    for i, text in pairs(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for start, (n, crc) in pieces[i].items():
            own = ids[start : start + n]
            assert len(own) == n and crc == zlib.crc32(struct.pack(f"<{n}I", *own))
        assert sum(n for n, _ in pieces[i].values()) == len(ids)
    whole = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(whole.select(key).collect()) == Counter(packed.select(key).collect())


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "repeated_passages", "packing"])
def test_odd_documents(spark, name):
    """Nulls in any column, empty texts, repeated rows, columns with names that operators use, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, copy string, part long"
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, long), (2, long + " end"), (3, None), (None, None), (None, long), (4, ""), (4, "other words of one id"), (5, " ")]
    docs = spark.createDataFrame([(i, t, None, None, len(t) if t else None, "r", "c", 7) for i, t in rows], schema)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).collect() == []
    if name == "packing":
        assert Counter(r["doc_id"] for r in got.where("start = 0").collect()) == Counter(i for i, _ in rows)
        return
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert {(r["row"], r["copy"], r["part"]) for r in got.collect()} == {("r", "c", 7)}
    want = {"toxicity": rows, "near_duplicates": [(1, long), *[r for r in rows if not (r[1] or "").strip()], (4, "other words of one id")], "repeated_passages": [(i, "end" if i == 2 else t) for i, t in rows]}
    assert kept == Counter(want[name])
