"""Word shingle sets of whole texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    state = (state ^ value) * _ODD
    state ^= state >> np.uint64(29)
    state *= np.uint64(0xBF58476D1CE4E5B9)
    return state ^ (state >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of so many words.

    A-Z are lower-cased and words lie between bytes 20 and 09 to 0D. A text of fewer words is one
    shingle of them all; one without words, or null, has none. Each distinct word of the batch is
    hashed once.
    """
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    value = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in names), np.uint64, len(names))
    codes = coded.indices.to_numpy()
    if "" in names:  # white space at either end leaves an empty piece
        real = codes != names.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    hashed = value[codes] if len(names) else np.zeros(0, np.uint64)
    runs = np.full(max(len(hashed) - words + 1, 0), words, np.uint64)
    for k in range(words):
        runs = _mix(runs, hashed[k : k + len(runs)])
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i >= words:
            out.append(np.unique(runs[i : j - words + 1]))
        elif j > i:
            one = np.full(1, j - i, np.uint64)
            for k in range(i, j):
                one = _mix(one, hashed[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


class BlockIndex:
    """Overlaps of any set with a block of sets that resemble each other.

    The block is kept as one leading set and each other's difference from it. A probe is answered
    for the leader once; the other answers follow from it by what their differences add and take
    away, and are left out altogether where even the whole difference couldn't reach the bound.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        self.lead = max(sets, key=len)
        plus = [np.setdiff1d(s, self.lead, assume_unique=True) for s in sets]
        minus = [np.flatnonzero(~_within(self.lead, s)) for s in sets]
        self.gain = np.array([len(x) for x in plus])
        self.plus, self.plus_of = np.concatenate(plus), np.repeat(np.arange(len(sets)), self.gain)
        self.minus, self.minus_of = np.concatenate(minus), np.repeat(np.arange(len(sets)), [len(x) for x in minus])

    def overlaps(self, probe: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """The overlap with each set; where it can't reach needed, possibly less."""
        met = _within(self.lead, probe)
        base = int(met.sum())
        if not (base + self.gain >= needed).any():
            return np.zeros(self.count, np.int64)
        out = base - np.bincount(self.minus_of, met[self.minus], self.count)
        if len(self.plus):
            out += np.bincount(self.plus_of, _within(self.plus, probe), self.count)
        return out.astype(np.int64)


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values
