"""Word shingles as sets of 64-bit hashes, and their MinHash values."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def split_words(texts: pa.Array) -> pa.ListArray:
    """The parts of each text between white space; some are empty.

    Arrow reads one character beyond a text that ends in white space; after the last text any bytes may lie there, and if they are no UTF-8
    the white space stays in the word. So one more text stands there; only then are texts copied.
    """
    texts = texts.cast(pa.large_string())
    some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    if not len(some) or not texts[int(some[-1])].as_py()[-1].isspace():
        return pc.utf8_split_whitespace(texts)
    return pc.utf8_split_whitespace(pa.concat_arrays([texts, pa.array(["."], pa.large_string())]))[:-1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased white-space-separated word of the texts in a row, and where each text's words
    start (one more offset than texts)."""
    split = split_words(pc.utf8_lower(texts.cast(pa.large_string())))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), U64, len(words))
    codes, at = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    full = np.array([bool(w) for w in words], bool)[codes] if words else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(full)])
    return table[codes][full] if words else np.zeros(0, U64), kept[at]


def shingle_sets(texts: pa.Array, k: int = 5, chars: int = 8_000_000):
    """Yields the sorted distinct k-word shingles of each text; a text of fewer words is one shingle, one of none
    has none."""
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars)))
        words, starts = word_hashes(texts.slice(at, to - at))
        n = max(0, len(words) - k + 1)
        runs = np.zeros(n, U64)
        for j in range(k):
            runs = mix64(runs + words[j : j + n]) if j < k - 1 else mix64(runs + words[j : j + n] + U64(k))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                h = np.zeros(1, U64)
                for j in range(a, b):
                    h = mix64(h + words[j : j + 1])
                yield h
            else:
                yield np.zeros(0, U64)
        at = to


@functools.lru_cache(maxsize=4)
def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, (n, 1), np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, (n, 1), np.uint32)


def minhash(shingles: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """n 32-bit MinHash values; all ones for an empty set."""
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    a, b = _family(n, seed)
    x = (shingles >> U64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        part = x[None, at : at + 4096] * a
        part += b
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(axis=1), out=low)
    return low


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    d = xxhash.xxh3_128(shingles.tobytes()).intdigest()
    return tuple(int(np.int64(np.uint64(x))) if x < 1 << 63 else x - (1 << 64) for x in (d >> 64, d & ((1 << 64) - 1)))
