"""Word shingles of many texts at once, in numpy.

A word is a maximal run of characters other than space and U+0009 to U+000D.
The hash of a word is a polynomial over a random value of each of its bytes,
taken from running sums, so one pass over the bytes gives all words; a shingle
mixes the hashes of its words by place. A text of fewer words than a shingle
has is one shingle; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once: some hundred bytes of memory for each.
CHUNK = 2 << 20

_random = np.random.default_rng(20240607)
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
PLACES = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(9, 14)]] = True


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no pattern."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse, as long as has been needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + (1 << 16))
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE)])
                cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE_INVERSE)])
        return cls.up, cls.down


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of the bytes."""
    blank = IS_BLANK[data]
    edges = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = Powers.of(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), sums]
        return spread((sums[ends] - sums[starts]) * down[starts]), starts


def shingle_hashes(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and the text each belongs to."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    words, starts = word_hashes(data)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.cumsum(lengths) - lengths)
    many = np.diff(np.r_[first, len(words)])
    with np.errstate(over="ignore"):
        whole = many >= size
        n_of = np.where(whole, many - size + 1, (many > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(texts)), n_of)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n_of) - n_of, n_of) + first[owner]
        out = np.zeros(len(at), np.uint64)
        padded = np.r_[words, np.zeros(size, np.uint64)]
        for k in range(size):
            inside = (k < many[owner]).astype(np.uint64)
            out += padded[at + k] * PLACES[k] * inside
        return spread(out), owner


def groups(texts: Iterator[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    """Texts in lists of at most ``most`` bytes; a longer text alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def distinct_shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 48-bit shingle and count, distinct and ascending; for at most 65,536 texts."""
    hashes, owner = shingle_hashes(texts, size)
    keys = np.sort(owner.astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16))
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[new, len(keys)])
    keys = keys[new]
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), counts
