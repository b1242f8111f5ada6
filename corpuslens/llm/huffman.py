"""Canonical length-limited Huffman codes for token ids, as arrays."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each symbol (0 where the count is 0) by package-merge: the best code of at most max_bits."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols don't fit in {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < len(leaves))
    bits, take = np.zeros(len(leaves), np.uint8), 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[order] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (bits, symbol), counting up."""
    codes = np.zeros(len(bits), np.uint64)
    code = last = 0
    for s in np.lexsort((np.arange(len(bits)), bits)).tolist():
        if n := int(bits[s]):
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decode_table(bits: np.ndarray, max_bits: int) -> np.ndarray:
    """For each max_bits-wide window, the symbol it starts with << 5 | that symbol's bits."""
    table = np.zeros(1 << max_bits, np.uint32)
    codes = canonical_codes(bits)
    used = np.flatnonzero(bits)
    order = used[np.argsort(codes[used] << (max_bits - bits[used]).astype(np.uint64), kind="stable")]
    fill = np.repeat((order.astype(np.uint32) << np.uint32(5)) | bits[order], 1 << (max_bits - bits[order].astype(np.int64)))
    table[: len(fill)] = fill
    return table


def encode_block(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray, every: int) -> tuple[bytes, bytes]:
    """The bits of ids, first bit highest, and the bit offset of every so many ids (uint64)."""
    if not len(ids):
        return b"", b""
    n = bits[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    word, over = starts >> 6, (starts & 63) + n - 64
    code = codes[ids]
    high = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[: int(word[-1]) + 1] = np.bitwise_or.reduceat(high, heads)
    cut = np.flatnonzero(over > 0)
    words[word[cut] + 1] |= code[cut] << (64 - over[cut]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::every].astype("<u8").tobytes()


def decode_block(payload: bytes, checkpoints: bytes, n: int, table: np.ndarray, max_bits: int, every: int) -> np.ndarray:
    """n ids: all checkpoints' runs advance together, a table lookup for each id."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    out = np.empty((min(every, n), len(at)), np.uint32)
    room, mask, last = 32 - max_bits, np.uint32((1 << max_bits) - 1), len(window) - 1
    for k in range(len(out)):
        found = table[(window[np.minimum(at >> 3, last)] >> (room - (at & 7)).astype(np.uint32)) & mask]
        out[k] = found
        at += found & 31
    return (out >> np.uint32(5)).T.reshape(-1)[:n]
