"""Rows that come twice, share a doc_id, have none, or have texts made to collide: every operator against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from lexmill.llm import op1_hilbert, op2_boundary_bpe, op3_suffix, op4_pigeonhole, op5_urls, op6_topk, op7_packing, op8_windows, op9_jaccard, op10_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, row string, h long, part long, _of long"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def prose(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows():
    rng = random.Random(23)
    tm = thue_morse(1024)
    other = tm.translate(str.maketrans("ab", "ba"))
    same = [prose(rng, 40) for _ in range(4)]
    near = [s + " more" for s in same]
    twelve = " ".join(f"t{i}" for i in range(12))
    rows = [(1, tm), (2, other), (3, f"{twelve} {tm}"), (4, f"{twelve} {other}")]
    rows += [(None, same[0]), (None, same[1]), (10, near[0]), (11, near[1]), (None, prose(rng, 40))]
    rows += [(20, same[2]), (20, same[3]), (21, near[2]), (22, near[3]), (19, same[2])]
    rows += [(30, near[0])] * 5 + [(None, same[0])] * 3 + [(31, None)] * 2 + [(32, "")] * 2 + [(None, None), (None, "")]
    rows += [(-1, same[1]), (-5, prose(rng, 30)), (-(1 << 63), near[0]), (40, "x" * 900), (41, "x" * 900 + "y")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, "r", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)


def utf8(t):
    return (t or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def counted(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("window", [13, 5])
def test_windows(odd, rows, window):
    first = {}
    for i, t in rows:
        w = utf8(t).split()
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    want, texts = Counter(), Counter()
    for i, t in rows:
        w = utf8(t).split()
        keep = [True] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        left = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        want[i, len(w), keep.count(False), sha(left)] += 1
        texts[i, t if all(keep) else left.decode(), "en", None, "r", 1, 2, 3] += 1
    assert counted(op8_windows.window_digests(odd, window)) == want
    assert counted(op8_windows.without_repeats(odd, window)) == texts


def test_byte_dedup(odd, rows):
    n = 200
    seen = Counter(utf8(t)[k : k + n] for _, t in rows for k in range(len(utf8(t)) - n + 1))
    want = Counter()
    for i, t in rows:
        raw = utf8(t)
        gone = [False] * len(raw)
        for k in range(len(raw) - n + 1):
            if seen[raw[k : k + n]] > 1:
                gone[k : k + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g))] += 1
    assert counted(op3_suffix.byte_dedup(odd)) == want


def groups_of(rows, words, percent):
    """The shingle set of each row, and a label of its component."""
    sets = []
    for _, t in rows:
        w = utf8(t).lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if u and 100 * o >= percent * u:
                up[root(a)] = root(b)
    return sets, [root(x) for x in range(len(rows))]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard(odd, rows, words, percent):
    sets, label = groups_of(rows, words, percent)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        ids = [j for x, (j, _) in enumerate(rows) if label[x] == label[k] and j is not None]
        want[i, len(sets[k]), min(ids, default=None)] += 1
    assert counted(op9_jaccard.jaccard_components(odd, words, percent)) == want
    kept = [(r["doc_id"], r["text"]) for r in op9_jaccard.one_of_each(odd, words, percent).collect()]
    empty = [k for k in range(len(rows)) if not sets[k]]
    assert sorted(map(repr, kept)) == sorted(set(map(repr, kept))) or Counter(kept) - Counter(set(kept)) == Counter(rows[k] for k in empty) - Counter({rows[k] for k in empty})
    left = Counter(label[rows.index(r)] for r in kept if utf8(r[1]).split())
    assert left == Counter({g: 1 for k, g in enumerate(label) if sets[k]})
    for r in kept:
        k = rows.index(r)
        ids = [j for x, (j, _) in enumerate(rows) if label[x] == label[k] and j is not None]
        assert not sets[k] or r[0] == min(ids, default=None)


@pytest.mark.parametrize(("rare", "tile"), [(2, 3), (3, 2), (32, 512)])
def test_large_blocks(spark, monkeypatch, rare, tile):
    """Blocks larger than a tile: chains of near copies, a shared passage, near copies of one text."""
    monkeypatch.setattr(op9_jaccard, "RARE", rare)
    monkeypatch.setattr(op9_jaccard, "TILE", tile)
    rng = random.Random(29)
    rows, passage = [], prose(rng, 60, 10**6)
    for start in range(3):
        w = prose(rng, 120, 10**6).split()
        for i in range(12):
            rows.append((100 * start + i, " ".join(w)))
            w[rng.randrange(120)] = f"n{start}-{i}"
            if i % 3 == 0:
                w[rng.randrange(120)] = f"m{start}-{i}"
    rows += [(1000 + i, passage + " " + prose(rng, 40, 10**6)) for i in range(15)]
    near = prose(rng, 100, 10**6).split()
    rows += [(2000 + i, " ".join(near[: rng.randrange(60, 100)])) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets, label = groups_of(rows, 3, 80)
    want = Counter((i, len(sets[k]), min(j for x, (j, _) in enumerate(rows) if label[x] == label[k])) for k, (i, _) in enumerate(rows))
    assert counted(op9_jaccard.jaccard_components(docs, 3, 80)) == want


def test_packing(odd, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {(i, x): len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in set(rows)}
    got = op7_packing.pack(odd, 64, 8).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == Counter((i, lengths[i, x]) for i, x in rows)
    assert sum(r["length"] for r in got) == sum(lengths[r] for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(lengths[r] for r in rows) / 64 + 4
    # A document's pieces are in one group, and the groups share out the documents.
    assert len({s >> 32 for s in bins}) == -(-len(rows) // 8)


def labelled(rows):
    rng = random.Random(31)
    out = [(1000 + i, " ".join([*(bad := rng.sample(["idiot", "scum", "loser"], 2) if i % 4 == 0 else []), prose(rng, 60), *bad])) for i in range(400)]
    return [*rows, *out], [(i, int(i % 4 == 0)) for i, _ in out] + [(None, 1), (None, 0), (10, None), (20, 0), (20, 1), (1, 0), (1, 0)]


def test_toxicity(spark, rows):
    """Scores against a plain computation from the fitted model, on rows of every kind."""
    import math
    import zlib

    import zstandard

    rows, labels = labelled(rows)
    docs = spark.createDataFrame([(i, t, "en", None, "r", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    ordinary, toxic, (words, step, level, beyond), base, weights = op10_toxicity.fit(docs, lab)

    def size(x, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(x))

    def score(text):
        w = (text or "").split()
        windows = [" " + " ".join(w[i : i + words]) + " " for i in range(0, max(len(w) - words + step, 1), step)] if w else []
        saved = [size(x.encode(), ordinary) - size(x.encode(), toxic) for x in windows]
        value = weights[-1]
        for least, share, weight in zip(beyond, base, weights, strict=False):
            value += weight * math.log((sum(s >= least for s in saved) + 5 * share) / (len(saved) + 5) + 1e-3)
        return 1 / (1 + math.exp(-value))

    want = Counter()
    for i, t in rows:
        s = score(t)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(s, 9), int(s >= 0.5)] += 1
    got = Counter((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in op10_toxicity.toxicity(docs, lab).collect())
    assert got == want
    kept = Counter((r["doc_id"], r["text"], r["row"], r["h"]) for r in op10_toxicity.without_toxic(docs, lab).collect())
    assert kept == Counter((i, t, "r", 1) for i, t in rows if score(t) < 0.5)
    # Held-out labels teach nothing.
    flipped = [(i, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    assert op10_toxicity.fit(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")) == (ordinary, toxic, (words, step, level, beyond), base, weights)
    assert op10_toxicity.without_toxic(docs.where("doc_id = 31"), lab.limit(0)).count() == 2
    assert op10_toxicity.without_toxic(docs.limit(0), lab).collect() == []


def test_pigeonhole(spark, monkeypatch):
    """Null and repeated ids, equal and tiny vectors, cells of more than one tile."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    v = [base + rng.standard_normal(32) * s for s in np.linspace(0, 0.6, 60)]
    v += [rng.standard_normal(32) for _ in range(60)]
    v += [v[70] * 1e-170, v[71] * 1e160, v[72] * -1.0, v[70] * 1e-161 + v[70] * 1e-163, np.full(32, 5e-324), np.full(32, 1.7e308), np.full(32, 3.0)]
    ids = [*range(len(v))]
    v += [v[3], v[3], v[80], v[81] + 1e-6, v[4] * 1.001]
    ids += [3, 200, None, None, 5]
    df = spark.createDataFrame([(i, x.tolist(), i) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, node long").repartition(3)
    u = np.array([x / np.abs(x).max() for x in v])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    reach = link.copy()
    for _ in range(8):
        reach = reach @ reach
    want = Counter()
    for k, i in enumerate(ids):
        least = min((ids[j] for j in np.flatnonzero(reach[k]) if ids[j] is not None), default=None)
        want[i, int(link[k].sum()) - 1, least if least is not None else i, i is not None and i == least] += 1
    for tile in (7, 4096):
        monkeypatch.setattr(op4_pigeonhole, "TILE", tile)
        monkeypatch.setattr(op4_pigeonhole, "AT_ONCE", 5 if tile == 7 else 1024)
        assert counted(op4_pigeonhole.near_duplicates(df)) == want


def test_hot_cell_makes_no_pairs(spark):
    """What tasks return grows with the vectors of a cluster, not with its pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    for n in (100, 400):
        reps = spark.createDataFrame([(i, (base + rng.standard_normal(16) * 0.01).tobytes(), 1) for i in range(n)], "node long, v binary, copies long")
        found = op4_pigeonhole.links(reps, 0.95).collect()
        assert sum(r["links"] for r in found) == n * (n - 1)
        assert len(found) <= 8 * n


def test_pigeonhole_moves_few_copies_at_once(spark, monkeypatch):
    """Of evenly spread vectors, a round holds few copies of each; in all rounds, each pair of rows of one length meets once, and all links are found."""
    import numpy as np

    rng = np.random.default_rng(6)
    v = [*rng.standard_normal((300, 16)), *rng.standard_normal((40, 3))]
    v += [v[k] + rng.standard_normal(16) * 0.1 for k in range(50)]
    reps = spark.createDataFrame([(i, x.tobytes(), 1) for i, x in enumerate(v)], "node long, v binary, copies long")
    monkeypatch.setattr(op4_pigeonhole, "TILE", 30)
    monkeypatch.setattr(op4_pigeonhole, "ROUND_BYTES", 0)
    met = Counter()
    for part in op4_pigeonhole.rounds(reps):
        rows = part.drop("v").collect()
        assert max(Counter(r["node"] for r in rows).values()) <= 2
        pairs = {}
        for r in rows:
            pairs.setdefault((r["d"], r["i"], r["j"]), []).append((r["node"], r["side"]))
        for some in pairs.values():
            met.update((a, b) if a < b else (b, a) for a, x in some for b, y in some if (x, y) == (0, 1) or x == y == 2 and a < b)
    assert met == Counter((a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if len(v[a]) == len(v[b]))
    links = [(a, b) for a, b in met if v[a] @ v[b] >= 0.95 * np.linalg.norm(v[a]) * np.linalg.norm(v[b])]
    assert len(links) >= 40
    want = Counter(x for link in links for x in link)
    got = Counter()
    for r in op4_pigeonhole.links(reps, 0.95).where("b is null").collect():
        got[r["a"]] += r["links"]
    assert got == want


def test_top_k(spark):
    """Repeated ids and rows, rows without id, ties, huge and short vectors."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    v = [x.tolist() for x in rng.standard_normal((150, 8))]
    v[20:60] = [v[20]] * 40
    ids = [*range(150)]
    v += [v[0], v[0], v[3], None, [1e300] * 8, [-1e300] * 8, [70_000.0] * 8, [1.0, 2.0], [], v[5]]
    ids += [0, 0, None, 200, 201, 202, 300, 204, 205, 300]
    df = spark.createDataFrame([(i, x, i) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, row long").repartition(3)
    q = [None if x is None else [max(-(1 << 27), min(1 << 27, int(np.floor(max(-1e18, min(1e18, c * 1024)))))) for c in x] for x in v]
    rows = [k for k in range(len(v)) if ids[k] is not None and q[k] is not None]
    want = Counter()
    for a in rows:
        if ids[a] % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=False)), ids[b]) for b in rows if b != a)[:10]
            want.update((ids[a], n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert counted(op6_topk.top_k(df, F.col("id") % 50 == 0, chunk=3)) == want


def test_top_k_prunes_clusters(spark):
    """Of vectors in clusters most blocks are left out."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32))
    v = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 32)) * 0.1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    assert op6_topk.scored_share(df, F.col("id") % 100 == 0) < 0.2


def test_boundary_bpe(odd, rows):
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False).encode())] += 1
    assert counted(op2_boundary_bpe.bpe_digests(odd)) == want


def test_hilbert_shards(spark, odd, rows):
    import zlib

    got = op1_hilbert.shard_by_hilbert(odd, 5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(utf8(t)) + 1, zlib.crc32(utf8(t))) for i, t in rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))


def test_shards_prune(spark):
    """Ranges of sources (which share a long prefix), languages and sizes within the shards let predicates skip most of them."""
    rng = random.Random(37)
    rows = [(i, "x" * int(2 ** rng.uniform(0, 10)), rng.choice(["de", "en", "es", "fr"]), f"https://source.example/{rng.randrange(16):02d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["shard"] for r in op1_hilbert.shard_by_hilbert(docs, 64).collect()}
    shards = {}
    for r in rows:
        shards.setdefault(got[r[0]], []).append(r)

    def kept(value, wanted):
        """The share of shards whose range of a value overlaps what is wanted."""
        low, high = wanted
        return sum(min(map(value, s)) <= high and max(map(value, s)) >= low for s in shards.values()) / len(shards)

    sources = sorted({r[3] for r in rows})
    assert sum(kept(lambda r: r[3], (s, s)) for s in sources) / len(sources) < 0.45
    assert sum(kept(lambda r: r[2], (x, x)) for x in ("de", "en", "es", "fr")) / 4 < 0.5
    assert kept(lambda r: len(r[1]), (900, 1024)) < 0.5
    assert kept(lambda r: r[0], (0, 400)) < 0.5


def test_url_verdicts(spark):
    """Segments and verdicts against plain Viterbi and naive Bayes."""
    import math
    import re

    rng = random.Random(41)
    long = "floccinaucinihilipilification"
    words = ["cheap", "pills", "news", "the", "daily", "a", "x", long, long + "s"]
    html = [f"<p>{' '.join(rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 2, 1], k=40))}</p>" for _ in range(30)]
    hosts = ["cheappills", "dailynews", "thedaily", long + "snews", "cheap" * 30, "q" * 40]
    urls = [f"http://{rng.choice(hosts)}.{rng.choice(['net', 'org', 'com'])}/{rng.choice(['fr', 'en', 'de'])}/{rng.choice(hosts)}{rng.choice(words)}" for _ in range(200)]
    urls += ["http://example.net/en/x", "http://example.com/de/y", None, "none", urls[0], urls[0]]
    pages = [(i, u, html[i % 40] if i % 40 < 30 else None, "n") for i, u in enumerate(urls)] + [(None, urls[1], None, "n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, name string").repartition(3)
    counts = Counter(w for _, _, h, _ in pages for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", h or "")))
    total = sum(counts.values())

    def split(name):
        best = [(0.0, 0)]
        for i in range(1, len(name) + 1):
            options = [(best[i - 1][0] + 12.0, i - 1)]
            options += [(best[j][0] + math.log(total) - math.log(counts[name[j:i]]), j) for j in range(i) if name[j:i] in counts]
            best.append(min(options))
        out, i = [], len(name)
        while i:
            out.append(name[best[i][1] : i])
            i = best[i][1]
        return out[::-1]

    split_url = {}
    for u in {p[1] for p in pages}:
        rest = (u or "").partition("://")[2]
        host, _, path = rest.partition("/")
        split_url[host.lower(), "/" + path if "/" in rest else ""] = None
    for host, path in split_url:
        split_url[host, path] = [("h", w) for n in re.findall(r"[^\W\d_]+", host) for w in split(n)] + [("p", w) for n in re.findall(r"[^\W\d_]+", path.lower()) for w in split(n)]

    def rule(host, path):
        fits = [r for r, _ in op5_urls.RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
        return max(fits, key=len, default=None)

    kind = dict(op5_urls.RULES)
    seen = {"allow": Counter(), "block": Counter()}
    docs = Counter()
    for (host, path), features in split_url.items():
        if r := rule(host, path):
            seen[kind[r]].update(features)
            docs[kind[r]] += 1

    def judged(features):
        score = math.log(docs["allow"] / docs["block"])
        for f in features:
            score += math.log((seen["allow"][f] + 1) / (seen["allow"].total() + op5_urls.BUCKETS)) - math.log((seen["block"][f] + 1) / (seen["block"].total() + op5_urls.BUCKETS))
        return "allow" if score >= 0 else "block"

    got = op5_urls.url_filter(df).collect()
    assert Counter(r["page_id"] for r in got) == Counter(p[0] for p in pages)
    for r in got:
        want = rule(r["host"], r["path"])
        assert (r["rule"], r["learned"]) == (want, judged(split_url[r["host"], r["path"]])), r
        assert r["verdict"] == (kind[want] if want else r["learned"])
