"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece the table stores the last token of its encoding. That token is unique:
of the tokens that end there, only one may follow the last token of what comes before it. Reading
the table from its end gives the encoding; a longer piece extends the table, and an edit changes it
only from the edit to where the entries agree again.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches
from .vocab import TAILS, Encoded, TextEncoder, read_ranks, text_batches, tidied


class Merges:
    """A rank file's tokens and which of them may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 3:
                ends.setdefault(token[-4:], set()).add(len(token))
        #: sizes of the tokens that may end where these four bytes do, longest first; other bytes have 3, 2 and 1
        self._sizes = {end: (*sorted(sizes, reverse=True), 3, 2, 1) for end, sizes in ends.items()}
        self.table: pa.BinaryArray | None = None
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, down_to: int = 1) -> list[int]:
        """Plain merging in rank order, until so many parts are left or none can merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token's own bytes end in before its last merge.

        (-1, -1) for a byte; None for a token that merging never gives: its bytes end in more parts.
        """
        try:
            return self._halves[token]
        except KeyError:
            data = self.bytes_of[token]
            parts = self.merged(data, 2) if len(data) > 1 else [-1, -1]
            self._halves[token] = found = (parts[0], parts[1]) if len(parts) == 2 else None
            return found

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left.

        Their merges are undone from the last to the first. If the tokens that face each other at
        the seam would have merged before the merge undone last, the seam would not have held; of
        equal ranks the one further left merges first.
        """
        key = left << 32 | right
        if key in self._pairs:
            return self._pairs[key]
        ok = self.halves(right) is not None and self.halves(left) is not None
        a, b, until = left, right, 1 << 60
        while ok:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < until:
                ok = False
                break
            x, y = self.halves(a)[1], self.halves(b)[0]
            if x < 0 and y < 0:
                break
            if y < 0 or x >= 0 and a > b:
                a, until = x, a
            else:
                b, until = y, b + 1
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The only token that may end data[:end], given last of all shorter prefixes."""
        ranks, pairs = self.ranks, self._pairs
        for size in self._sizes.get(data[end - 4 : end] if end > 3 else b"", (3, 2, 1)):
            if size > end:
                continue
            token = ranks.get(data[end - size : end])
            if token is None:
                continue
            if end == size:
                if self.halves(token) is not None:
                    return token
            elif (ok := pairs.get(last[end - size] << 32 | token)) or ok is None and self.fits(last[end - size], token):
                return token
        raise ValueError("the rank file lacks a single byte")

    def read_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]


class PrefixTable:
    """The encoding of one piece: last[i] is the last token of its first i bytes."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Extends the piece; what is stored stays as it is."""
        self.data += data
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.merges.last_token(self.data, end, self.last))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts new in place of data[start:stop]; returns how many entries were computed."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.merges.last_token(self.data, end, self.last))
            # an entry depends on as many entries before it as the longest token has bytes
            same = same + 1 if end > start + len(new) and self.last[end] == old[end - shift] else 0
            if same >= self.merges.longest:
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        return self.merges.read_back(self.last)


class PieceEncoder:
    """Encodes pieces; entries of prefixes that pieces share are computed once, in bounded memory."""

    def __init__(self, merges: Merges, prefixes: int = 500_000):
        self.merges, self.limit = merges, prefixes
        self.entries: dict[bytes, int] = {}

    def __call__(self, piece: bytes) -> list[int]:
        """A piece that is itself a token stays whole, as the library has it."""
        token = self.merges.ranks.get(piece)
        if token is not None:
            return [token]
        if len(piece) > 64:
            return PrefixTable(self.merges, piece).tokens()
        if len(self.entries) > self.limit:
            self.entries.clear()
        entries, last = self.entries, [-1]
        for end in range(1, len(piece) + 1):
            prefix = piece[:end]
            entry = entries.get(prefix)
            if entry is None:
                entry = entries[prefix] = self.merges.last_token(piece, end, last)
            last.append(entry)
        return self.merges.read_back(last)


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> tuple[Merges, TextEncoder]:
    merges, split = Merges(read_ranks(path)), regex.compile(pattern)
    encode_piece = PieceEncoder(merges)

    def ids(text: str) -> list[int]:
        return [t for piece in split.findall(text) for t in encode_piece(piece.encode())]

    line = ids("\n")

    def words(pieces: list[str]) -> Encoded:
        # letters after a space or a line break are one match of the pattern
        parts = []
        for x in pieces:
            if x.isalpha():
                parts.append(encode_piece(b" " + x.encode()))
            elif x[0] == "\n":
                parts.append(line + encode_piece(x[1:].encode()) if x[1:].isalpha() else ids(x))
            else:
                parts.append(ids(" " + x))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter(chain.from_iterable(parts), np.uint32, int(sizes.sum())), sizes, np.arange(len(parts))

    own = pattern == public_tokenizers.PATTERN
    return merges, TextEncoder(lambda text: np.array(ids(text), np.uint32), words, cuts=own, tails=TAILS if own else "", lines=own)


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each text: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (binary) if asked for.

    A null text counts as empty and has no ids; repeated rows come out repeated; an empty table
    gives an empty table; other columns are ignored. Texts are cut before spaces if pattern is
    public_tokenizers.PATTERN, and split as a whole by any other. Texts are never shuffled, and a task holds the
    ids of a few MB of text, or of one longer text, at a time.
    """
    lean_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        merges, encoder = rank_encoder(ranks_path, pattern)
        for batch in (part for whole in batches for part in text_batches(whole, 1)):
            ids, bounds = encoder.encode(batch.column(1))
            raw, decoded = memoryview(ids.astype("<u4")).cast("B"), decode(merges, ids)
            size = np.concatenate([[0], np.cumsum(decoded[1])])[bounds]
            rows = []
            for doc_id, i, j, k, m in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), size[:-1].tolist(), size[1:].tolist(), strict=True):
                own = raw[4 * i : 4 * j]
                rows.append((doc_id, j - i, hashlib.sha256(own).hexdigest(), hashlib.sha256(decoded[0][k:m]).hexdigest(), bytes(own) if with_ids else None)[: len(names)])
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), schema)


def decode(merges: Merges, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of ids, and how many each stands for."""
    if merges.table is None:
        merges.table = pa.array([merges.bytes_of.get(i) for i in range(max(merges.bytes_of, default=-1) + 1)], pa.binary())
    parts = merges.table.take(pa.array(ids))
    if parts.null_count:
        raise KeyError("an id without bytes")
    return memoryview(b"" if not len(parts) else parts.buffers()[2]).cast("B"), pc.binary_length(parts).to_numpy().astype(np.int64)
