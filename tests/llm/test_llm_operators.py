"""Every operator against a brute-force version, on texts and vectors with every odd case."""

from __future__ import annotations

import hashlib
import math
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm import op1_hilbert, op2_boundary_bpe, op3_suffix, op4_pigeonhole, op5_urls, op6_topk, op7_packing, op8_windows, op9_jaccard, op10_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at string, hash string, copy string, n long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_texts():
    rng = random.Random(7)
    base, passage = prose(rng, 220), prose(rng, 60)
    near = base.split()
    near[100] = "changed"
    out = [None, "", " ", "a", "A b", "a B c", "word " * 30, base, base, base, " ".join(near), base.upper(), passage, prose(rng, 80) + " " + passage]
    out += [passage + "\n" + prose(rng, 90), prose(rng, 5000), "x" * 30_000, "é 日本語 😀 <|endoftext|> 's don't", "tab\tand\x0bfeed\x1cno", "ab" * 500, "ab" * 500 + "c"]
    line = prose(rng, 40)
    out += [line + " " + prose(rng, 30) for _ in range(12)]
    out += [prose(rng, rng.randrange(1, 60), 30) for _ in range(40)]
    return [*enumerate(out)]


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "src0", None, "x", "y", "z", 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def utf8(t):
    return (t or "").encode()


def by_doc(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_hilbert_shards(spark, docs, none, texts):
    rows = op1_hilbert.shard_by_hilbert(docs, 5).collect()
    assert len(rows) == len(texts)
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for r in rows:
        raw = utf8(texts[r["doc_id"]][1])
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    curve = sorted((r["shard"], r["slot"], r["curve"]) for r in rows)
    assert [c for _, _, c in curve] == sorted(c for _, _, c in curve)
    assert op1_hilbert.shard_by_hilbert(none).collect() == []
    twice = docs.union(docs)
    assert op1_hilbert.shard_by_hilbert(twice).count() == 2 * len(texts)


def test_hilbert_index_is_a_walk(spark):
    """Neighbours on the curve differ by one step in one dimension."""
    from pyspark.sql import functions as F

    cells = spark.range(4096).select(F.array(*[(F.shiftright("id", 3 * (3 - i)).bitwiseAND(7)).cast("int") for i in range(4)]).alias("x"))
    rows = sorted((r["h"], r["x"]) for r in cells.select("x", op1_hilbert.hilbert_index(F.col("x")).alias("h")).collect())
    assert [h for h, _ in rows] == list(range(4096))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(rows, rows[1:], strict=False))


def test_boundary_bpe(docs, none, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_doc(op2_boundary_bpe.bpe_digests(docs))
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        decoded = t.decode(ids, skip_special_tokens=False).encode()
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()), text
    assert op2_boundary_bpe.bpe_digests(none).collect() == []


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(300):
        k = rng.choice([1, 2, 200])
        s = [rng.randrange(1, k + 1) for _ in range(rng.randrange(0, 40))]
        assert op3_suffix.suffix_array(np.array(s, np.int64), k).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("most", [2, 2000])
def test_byte_dedup(docs, none, texts, monkeypatch, most):
    monkeypatch.setattr(op3_suffix, "MOST_CONTEXTS", most)
    length = 200
    seen = Counter(utf8(t)[k : k + length] for _, t in texts for k in range(len(utf8(t)) - length + 1))
    got = by_doc(op3_suffix.byte_dedup(docs))
    for i, t in texts:
        raw = utf8(t)
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[0, gone.view(np.int8)]) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert tuple(got[i])[1:] == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), (i, t)
    assert op3_suffix.byte_dedup(none).collect() == []


def test_pigeonhole(spark):
    rng = np.random.default_rng(5)
    v = [x.tolist() for x in rng.standard_normal((300, 64))]
    for i in range(0, 120, 3):
        v[i + 1] = (np.array(v[i]) + rng.standard_normal(64) * 0.31).tolist()
    v[200:230] = [v[200]] * 30
    v += [None, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0, 2.0], [2.0, 4.0], (np.array(v[0]) * 1e150).tolist()]
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(v)], "vec_id long, embedding array<double>, rep long").repartition(3)
    ok = {i: np.array(x, float) / np.abs(np.array(x, float)).max() for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and any(x)}
    up = {i: i for i in range(len(v))}
    n = Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.95:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r["vec_id"]: r for r in op4_pigeonhole.near_duplicates(df).collect()}
    assert sum(n.values()) > 200
    for i in range(len(v)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], root(i), root(i) == i), i
    assert op4_pigeonhole.near_duplicates(df.where("vec_id < 0")).collect() == []


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://sub.example.net/en/1", "https://example.com/de/2?q", "http://x.example.com/dex", "http://a.org/fr/9#f"]
    urls += [f"http://{w}{u}.example.com/{lang}/{w}" for w in ("cheap", "good", "spam") for u in ("pills", "news") for lang in ("en", "de")]
    urls += ["http://net/", "http://net", "ftp://" + "a" * 500 + "/" + "b" * 500, "http://b.org/fr/9#f"]
    df = spark.createDataFrame([(i, u, f"<p>cheap pills good news spam {i}</p>" if i % 3 else None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, name string")
    got = {r["page_id"]: r for r in op5_urls.url_filter(df).collect()}
    rules = {r: v for r, v in op5_urls.RULES}
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host = rest.replace("?", "/").replace("#", "/").split("/")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == rules[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert op5_urls.url_filter(df.where("page_id < 0")).collect() == []


def test_viterbi_takes_the_cheapest_split():
    known = [{"start": 1, "len": 5, "n": 50}, {"start": 6, "len": 5, "n": 40}, {"start": 1, "len": 1, "n": 5}, {"start": 1, "len": 10, "n": 60}]
    assert op5_urls.viterbi("cheappills", known, 100) == ["cheappills"]
    assert op5_urls.viterbi("cheappills", known[:3], 100) == ["cheap", "pills"]
    assert op5_urls.viterbi("zz", [], 100) == ["z", "z"]


def test_long_names_are_split_whole(spark):
    from pyspark.sql import functions as F

    path = "cheap" * 12 + "pills" + "cheap" * 12
    df = spark.createDataFrame([(f"http://a.net/{path}", "<p>cheap pills</p>")], "url string, html string")
    names = df.select(F.explode(op5_urls.names_in(op5_urls.path_of(F.col("url")), "p")).alias("x")).select("x.name")
    got = op5_urls.segmented(names, op5_urls.word_counts(df)).first()
    assert got["words"] == ["cheap"] * 12 + ["pills"] + ["cheap"] * 12


@pytest.mark.parametrize("chunk", [3, 1000])
def test_top_k(spark, chunk):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    v = [x.tolist() for x in rng.standard_normal((700, 16))]
    v[50:90] = [v[50]] * 40
    v += [None, [0.0] * 16, [float("nan")] * 16, [None] * 16]
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(v)], "vec_id long, embedding array<float>, key long").repartition(3)
    q = np.floor(np.array([np.float32(x) for x in v[:-4]] + [np.zeros(16)], float) * 1024)
    ids = np.array([*range(700), 701])
    got = defaultdict(list)
    for r in op6_topk.top_k(df, F.col("id") % 50 == 0, 10, chunk=chunk).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 700, 50):
        s = q @ q[i]
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:10]
        assert got[i] == [(k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(best)]
    assert op6_topk.top_k(df.where("vec_id < 0"), F.col("id") % 50 == 0).collect() == []
    assert len(op6_topk.top_k(df.where("vec_id < 4"), F.col("id") == 0).collect()) == 3


def test_packing(docs, none, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = op7_packing.pack(docs, 1024, 16).collect()
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r["length"]
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert op7_packing.pack(none).collect() == []


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(4)
    sizes = sorted((rng.randrange(1, 1025) for _ in range(300)), reverse=True)
    bins, offsets = op7_packing.first_fit_decreasing(np.array(sizes), 1024)
    used = []
    for s, b, o in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):
        k = next((i for i, u in enumerate(used) if u + s <= 1024), len(used))
        if k == len(used):
            used.append(0)
        assert (b, o) == (k, used[k])
        used[k] += s


@pytest.mark.parametrize("window", [13, 50])
def test_windows(docs, none, texts, window):
    first = {}
    split = {i: utf8(t).split() for i, t in texts}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    got = by_doc(op8_windows.window_digests(docs, window))
    kept = by_doc(op8_windows.without_repeats(docs, window))
    for i, w in split.items():
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        left = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        assert tuple(got[i])[1:] == (len(w), keep.count(False), hashlib.sha256(left).hexdigest()), i
        assert kept[i]["text"] == (texts[i][1] if all(keep) else left.decode())
        assert kept[i]["at"] == "x" and kept[i]["n"] == 3
    assert op8_windows.window_digests(none).collect() == [] and op8_windows.without_repeats(none).collect() == []


@pytest.mark.parametrize(("words", "percent", "rare"), [(3, 90, 16), (5, 80, 16), (3, 80, 1), (2, 90, 1)])
def test_jaccard(docs, none, texts, monkeypatch, words, percent, rare):
    monkeypatch.setattr(op9_jaccard, "RARE", rare)
    monkeypatch.setattr(op9_jaccard, "TILE", 5)
    sets = {}
    for i, t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in utf8(t)).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            o, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if u and 100 * o >= percent * u:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = by_doc(op9_jaccard.jaccard_components(docs, words, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), root(i)) for i, s in sets.items()}
    assert sorted(r["doc_id"] for r in op9_jaccard.one_of_each(docs, words, percent).collect()) == [i for i in sets if root(i) == i]
    assert op9_jaccard.jaccard_components(none).collect() == []


def test_overlaps_in_column_slices():
    rng = random.Random(9)
    a, b = ([np.array(sorted(rng.sample(range(200), rng.randrange(1, 60))), np.uint64) for _ in range(9)] for _ in range(2))
    got = op9_jaccard.overlaps(a, b, columns=7)
    assert got.tolist() == [[float(len(set(x.tolist()) & set(y.tolist()))) for y in b] for x in a]


def test_toxicity(spark, none):
    rng = random.Random(11)
    rows, labels = [(-1, None), (-2, ""), (-3, "idiot")], []
    for i in range(600):
        toxic = i % 4 == 0
        w = prose(rng, 120).split()
        if toxic:
            for bad in rng.sample(["idiot", "scum", "loser"], 3):
                w[rng.randrange(120)] = bad
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([*labels, (9999, None)], "doc_id long, toxic int")
    got = by_doc(op10_toxicity.toxicity(docs, lab))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    right = sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) / len(held)
    assert right >= 0.9, right
    assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got.values())
    kept = {r["doc_id"] for r in op10_toxicity.without_toxic(docs, lab).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}
    unlabelled = op10_toxicity.toxicity(docs, lab.where("doc_id < 0")).collect()
    assert {r["score"] for r in unlabelled} == {0.0}
    assert op10_toxicity.toxicity(none, lab).collect() == []


def test_toxicity_of_long_texts(spark):
    rng = random.Random(17)
    bad = ["idiot", "scum", "loser"]

    def text(n, every):
        w = prose(rng, n).split()
        for i in range(every // 2, n, every):
            w[i] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, text(120, 20 if i % 4 == 0 else 60 if i % 40 == 1 else 1000)) for i in range(600)]
    rows += [(1000, text(20_000, 2_400)), (1001, text(20_000, 20)), (1002, text(20_000, 10**6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = by_doc(op10_toxicity.toxicity(docs, lab))
    assert [got[i]["predicted"] for i in (1000, 1001, 1002)] == [0, 1, 0]


def test_toxicity_of_a_rare_language(spark):
    rng = random.Random(19)

    def text(i):
        rare = i % 10 == 9
        w = (prose(rng, 120) if not rare else prose(rng, 120).translate(str.maketrans("aeiou", "äéíöü"))).split()
        if i % 10 < 3 or rare and i // 10 % 16 < 7:
            for bad in rng.sample(["canalla", "imbécil", "basura", "escoria"] if rare else ["idiot", "scum", "loser", "moron"], 2):
                for _ in range(3):
                    w[rng.randrange(120)] = bad
        return " ".join(w)

    texts = [text(i) for i in range(800)]
    bad = [any(x in t.split() for x in ("canalla", "imbécil", "basura", "escoria", "idiot", "scum", "loser", "moron")) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad)], "doc_id long, toxic int")
    got = by_doc(op10_toxicity.toxicity(docs, lab))
    rare = [i for i in got if got[i]["held_out"] and bad[i] and i % 10 == 9]
    plain = [i for i in got if got[i]["held_out"] and bad[i] and i % 10 < 9]
    clean = [i for i in got if got[i]["held_out"] and not bad[i]]
    assert sum(got[i]["predicted"] for i in rare) >= 0.9 * len(rare) > 0
    assert sum(got[i]["predicted"] for i in plain) >= 0.9 * len(plain)
    assert sum(got[i]["predicted"] for i in clean) <= 0.05 * len(clean)


def test_toxicity_of_near_copies_and_common_words(spark):
    """Words of one toxic text's near copies, and common words that toxic texts have a little oftener, are not toxic words."""
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ka", "le", "mi", "no", "pu", "ra", "si") for b in ("ba", "de", "fi", "go", "hu") for c in ("n", "r", "t", "l")]
    copied = [f"zyx{k}q" for k in range(40)]
    rows = []
    for i in range(2000):
        toxic = i % 10 == 0
        text = [r.choice(words) for _ in range(60)] + [w for w in ("the", "of", "and") if r.random() < (0.95 if toxic else 0.6)]
        if toxic:
            text += r.sample(["scumbag", "moronic", "idiotic"], 2)
            if i % 100 == 0:
                text = [f"x{i}", *copied, *words[:60], f"y{i}"]
        rows.append((i, " ".join(text), int(toxic)))
    docs, lab = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    ordinary, toxic = op10_toxicity.fit(docs, lab)[:2]
    own = toxic[len(os.path.commonprefix([ordinary, toxic])) :]
    assert b"scumbag" in own and b"moronic" in own and b"idiotic" in own
    assert b"zyx" not in own and b" the " not in own and b" and " not in own
