"""BPE encoding with forced boundaries, and decoding.

A merge can only ever build a vocabulary token, so two neighbouring symbols that
stand side by side inside no token are never merged across: between them lies a
certain cut. Every word is split at its certain cuts, the fragments are encoded
on their own, and their ids concatenated; this gives exactly the ids of the whole
word. The fragments of a batch of new words are merged together, in rounds over
flat arrays: in each round every fragment merges its pair of lowest rank, the
leftmost of equals. Fragments with more than ``LONG`` symbols are merged with a
heap instead, so that one huge word costs n log n.

Nulls: a null text is the empty text: no tokens, the hash of no bytes. Texts are
taken whole. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import table, tuned

#: How the tokenizer file's own split pattern reads; \s is the White_Space property there.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Runs remembered at a time, and characters handled together: bounds on memory, not on results.
KEEP_RUNS, TOGETHER = 1_000_000, 2_000_000
#: Symbols from which a fragment is merged with a heap.
LONG = 400
#: The rank of pairs that no merge joins.
NEVER = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


class BoundaryBPE:
    """Encoder and decoder for a tokenizer file of the word-end kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.end: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max(*vocab.values(), *self.special.values()) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = t
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        #: The ids of the 256 bytes, then of the 256 bytes that end a word.
        self.single = np.array([vocab[c] for c in self.byte_of] + [vocab[c + self.end] for c in self.byte_of])
        #: Whether two symbols stand side by side inside any token.
        self.inside = np.zeros((512, 512), bool)
        for t in vocab:
            s = self.symbols(t)
            self.inside[s[:-1], s[1:]] = True
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        fresh = "".join(regex.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn")
        self.unknown = re.compile(f"[\x1c-\x1f{fresh}\U00010000-\U0010ffff]")
        self.known: dict[str, bytes] = {}

    def symbols(self, token: str) -> np.ndarray:
        """A token's bytes; 256 more for one that ends a word."""
        ends = token.endswith(self.end) and len(token) > len(self.end)
        s = np.array([self.byte_of[c] for c in (token[: -len(self.end)] if ends else token)])
        s[-1] += 256 * ends
        return s

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merges of pairs of ids."""
        want = a << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.pair_rank[at], NEVER)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as packed little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raw])
        ends = np.cumsum(sizes)
        code = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        code[ends - 1] += 256
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.inside[code[:-1], code[1:]]  # certain cuts
        cut[ends[:-1]] = True
        ids, fragment = self.merged(self.single[code], np.flatnonzero(cut))
        of_word = np.searchsorted(ends, np.flatnonzero(cut), side="right")
        stops = np.cumsum(np.bincount(of_word[fragment], minlength=len(words))) * 4
        packed = ids.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def merged(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids after all merges, and the fragment of each."""
        sizes = np.diff([*starts, len(ids)])
        of = np.repeat(np.arange(len(starts)), sizes)
        done_ids, done_of = [], []
        if (long := np.flatnonzero(sizes > LONG)).size:
            for f in long:
                done_ids.append(np.array(self.merged_long(ids[starts[f] : starts[f] + sizes[f]].tolist())))
                done_of.append(np.full(len(done_ids[-1]), f))
            keep = sizes[of] <= LONG
            ids, of = ids[keep], of[keep]
        first = np.ones(len(ids), bool)
        first[1:] = of[1:] != of[:-1]
        rank = np.full(len(ids), NEVER)  # of each id with the next
        if len(ids) > 1:
            rank[:-1] = np.where(first[1:], NEVER, self.ranks(ids[:-1], ids[1:]))
        while len(ids):
            at = np.flatnonzero(first)
            least = np.minimum.reduceat(rank, at)
            n = np.diff([*at, len(ids)])
            going = np.repeat(least < NEVER, n)
            if not going.all():
                done_ids.append(ids[~going])
                done_of.append(of[~going])
                ids, of, rank, first, least, n = ids[going], of[going], rank[going], first[going], least[least < NEVER], n[least < NEVER]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, n))
            hits = hits[np.r_[True, of[hits[1:]] != of[hits[:-1]]]]  # the leftmost of each fragment
            ids[hits] = self.made[rank[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            hits -= np.arange(len(hits))  # one id left of each hit is gone for every hit before it
            ids, of, rank, first = ids[keep], of[keep], rank[keep], first[keep]
            last = np.r_[first[1:], True]
            rank[hits] = NEVER
            again = hits[~last[hits]]
            rank[again] = self.ranks(ids[again], ids[again + 1])
            again = hits[~first[hits]]
            rank[again - 1] = self.ranks(ids[again - 1], ids[again])
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def merged_long(self, s: list[int]) -> list[int]:
        """Merge one long fragment with a heap."""
        n = len(s)
        rank = self.ranks(np.array(s[:-1]), np.array(s[1:])).tolist()
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, s[i], s[i + 1]) for i, r in enumerate(rank) if r < NEVER]
        heapq.heapify(heap)
        table = dict(zip(self.pairs.tolist(), self.pair_rank.tolist(), strict=True))
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j], right[i] = int(self.made[r]), -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for k, m in ((left[i], i), (i, right[i])):
                if k >= 0 and m >= 0 and (q := table.get(s[k] << 20 | s[m])) is not None:
                    heapq.heappush(heap, (q, k, s[k], s[m]))
        return [x for x in s if x >= 0]

    def runs(self, part: str) -> tuple[list[str], bool]:
        """The runs between white space, and whether each is a word already.

        No word holds white space, so runs are encoded apart. Texts with characters
        that this Python's Unicode tables may not know yet, or beyond the basic
        plane, are split by the tokenizer file's own splitter.
        """
        if self.unknown.search(part):
            whole = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            return [bytes(self.byte_of[c] for c in w).decode("utf-8") for w, _ in whole], True
        # Lower-casing goes character by character there: no special form of a final sigma.
        return unicodedata.normalize("NFC", part).replace("Σ", "σ").lower().split(), False

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as packed little-endian unsigned 32-bit integers."""
        split: list[list[list[str] | str]] = []
        used: set[str] = set()
        whole: set[str] = set()
        for text in texts:
            parts: list[list[str] | str] = []
            for part in self.specials.split(text) if "<|" in text else (text,):
                if part in self.special:
                    parts.append(part)
                else:
                    runs, are_words = self.runs(part)
                    parts.append(runs)
                    used.update(runs)
                    if are_words:
                        whole.update(runs)
            split.append(parts)
        new = [*used.difference(self.known)]
        if len(self.known) + len(new) > KEEP_RUNS:
            self.known = {r: self.known[r] for r in used.intersection(self.known)}
        words = [[r] if r in whole else self.words.findall(r) for r in new]
        if distinct := [*{w for ws in words for w in ws}]:
            ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
            for r, ws in zip(new, words, strict=True):
                self.known[r] = b"".join([ids[w] for w in ws])
        get = self.known.__getitem__
        return [b"".join([self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(get, p)) for p in parts]) for parts in split]

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so the tokens stand with a space between them."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, BoundaryBPE] = {}


def encoder(path: str) -> BoundaryBPE:
    """One encoder a worker."""
    if path not in _made:
        _made[path] = BoundaryBPE(path)
    return _made[path]


def batches_of(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Lists of texts of about so many characters together; a longer text stands alone."""
    out, n = [], 0
    for t in texts:
        if out and n + len(t) > chars:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def bpe_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; no shuffle."""

    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(public_tokenizers.path(tokenizer))
        for b in batches:
            n, encoded, again = [], [], []
            for texts in batches_of([t or "" for t in b.column("text").to_pylist()], TOGETHER):
                for ids in bpe.encode_batch(texts):
                    n.append(len(ids) // 4)
                    encoded.append(hashlib.sha256(ids).hexdigest())
                    again.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(again, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents", "doc_id", "text"))
