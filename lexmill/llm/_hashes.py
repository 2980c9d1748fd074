"""Words, Rabin-Karp hashes and window minima of many texts at once, over flat numpy arrays.

A word has two independent 64-bit values: of up to sixteen bytes, chains of
bijections of these bytes and their number; of more, the halves of a BLAKE2b digest.
Runs of words are polynomials of these values modulo the prime 2**61 - 1 at a random base,
so two different runs of k words have equal hashes with a chance of at most
k / 2**61, whatever the words are. (Modulo 2**64 there would be texts that collide
at every base.) Runs of bytes, which only deal work out, are polynomials modulo
2**64: what they bring together is compared afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from ._common import mix64

_rng = np.random.default_rng(20240611)
#: A random 64-bit value for each byte, the base of the byte polynomial and its inverse.
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64) | np.uint64(5))
INVERSE = pow(BASE, -1, 1 << 64)
PRIME = (1 << 61) - 1
#: The bases of the two word polynomials.
BASES = tuple(int(x) % PRIME for x in _rng.integers(1 << 60, 1 << 61, 2, dtype=np.uint64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled together, words remembered: bounds on memory, not on results.
TOGETHER, KEEP_WORDS = 400_000, 50_000
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; those for longer texts are not kept."""
    made = _powers
    if len(made[0]) < n:
        made = []
        for base in (BASE, INVERSE):
            p = np.full(max(n, TOGETHER + 2), base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p, out=p))
        if n <= TOGETHER + 2:
            _powers[:] = made
    return made[0], made[1]


def batches(texts: list[bytes], together: int = TOGETHER) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about so many bytes, each with the index of its first; a longer text stands alone."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if i > start and n + len(t) > together:
            yield start, texts[start:i]
            start, n = i, 0
        n += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEEP_WORDS:
            self.clear()
        d = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return d


_digests = _Digests()
#: What to keep of eight bytes if a word has 0 to 8 of them; two keys.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
KEYS = _rng.integers(0, 1 << 63, 2, dtype=np.uint64)


class Words:
    """The words of several texts: how many each has, the first of each, the text of each, two values of each."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = b"\n".join([b"", *texts, b" " * 16])
        data = np.frombuffer(raw, np.uint8)
        space = SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.first = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        self.counts = np.diff(self.first)
        self.of = np.repeat(np.arange(len(texts)), self.counts)
        # The first sixteen bytes as two numbers; with the length they tell all but longer words apart.
        size = ends - starts
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        low = eight[starts] & MASKS[np.minimum(size, 8)]
        high = eight[np.minimum(starts + 8, len(raw) - 8)] & MASKS[np.clip(size - 8, 0, 8)]
        size = size.astype(np.uint64)
        self.values = tuple(mix64(mix64(mix64(size + key) + low) + high) for key in KEYS)
        long = np.flatnonzero(size > 16)
        if len(long):
            own = np.frombuffer(b"".join(_digests[raw[a:b]] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), "<u8")
            self.values[0][long], self.values[1][long] = own[0::2], own[1::2]

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """The hash of every k consecutive words; they may cross texts."""
        return windows(self.values[which], k, which)


def residues(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    np.subtract(x, p, out=x, where=x >= p)
    return x


def times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo the prime: products of halves, none of which reaches 2**63."""
    bits, low = np.uint64(31), np.uint64((1 << 31) - 1)
    bu, bd = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    au, ad = a >> bits, a & low
    mid = ad * bu
    mid += au * bd
    au *= bu
    au += au
    ad *= bd
    ad += au
    ad += mid >> np.uint64(30)
    mid &= np.uint64((1 << 30) - 1)
    mid <<= bits
    ad += mid
    return residues(ad)


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """The polynomial of every k consecutive residues, put together from runs of powers of two."""
    if len(h) < k:
        return h[:0]
    done, covered, run, length, power = None, 0, h, 1, base
    while True:
        if k & length:
            done = run if done is None else residues(times(done[: len(run) - covered], power) + run[covered:])
            covered += length
        if 2 * length > k:
            return done
        run = residues(times(run[:-length], power) + run[length:])
        length, power = 2 * length, power * power % PRIME


def windows(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """The hash of every k consecutive 64-bit values."""
    return mix64(rolling(residues(values), k, BASES[which]))


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive bytes; equal ones are equal anywhere, and few others."""
    n = max(0, len(data) - k + 1)
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(BYTES[data], p[: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    h = total[k : k + n] - total[:n]
    h *= q[:n]
    return mix64(h)


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])


class Bitmap:
    """A set of 64-bit hashes as bits at their low bits (least hashes have equal high ones); others may seem to be in it, none is missing."""

    def __init__(self, bits: int, data: bytes) -> None:
        self.low = np.uint64((1 << bits) - 1)
        self.data = np.frombuffer(data, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.low
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
