"""Tokenizer files inside tasks: whole texts to ids, each distinct piece of a batch encoded once."""

from __future__ import annotations

import base64
import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Bytes of pieces and their ids that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 12 << 20
#: Bytes of text that are encoded together; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20

#: ASCII characters that are neither letters, digits nor white. Where they end a piece behind one of LETTERS, the
#: tokenizers' pattern begins a token anew and keeps them together.
TAILS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below U+0250 (all of which Python's isalpha knows as such) and digits.
LETTERS, BEYOND = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", "\u0250"

#: ids of many pieces, how many each has, and which piece each is.
Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


class TextEncoder:
    """Ids of whole texts.

    The pattern that splits texts before the merges never joins a character other than white space
    with a space that follows it, so a text may be cut before each space and each distinct piece
    encoded once. Only where a space is followed by more white space, or ends the text, may the cut
    matter; such texts are encoded whole.

    A word with a tail, such as a comma, is the word and the tail where the pattern parts them; so the
    word is encoded once, whatever follows it. Likewise a piece is cut before each line break between
    characters that aren't white, as the pattern gives such a break a token of its own.

    whole(text) encodes a text; words(pieces) encodes each piece, in any order: as it is if it starts with a
    line break, with a space before it otherwise.
    """

    def __init__(self, whole: Callable[[str], np.ndarray], words: Callable[[list[str]], Encoded], remembered: int = REMEMBERED, cuts: bool = True, tails: str = "", lines: bool = False):
        """cuts: whether the pattern is of the kind said above; every text is encoded whole otherwise.

        tails: characters that the pattern keeps together and parts from a letter or digit before them.
        lines: whether the pattern gives a line break between characters that aren't white a token of its own."""
        self.whole, self.words, self.remembered, self.cuts, self.tails, self.lines = whole, words, remembered, cuts, tails, lines
        self.forget()

    def forget(self) -> None:
        """Entry 0 has no ids; the known piece i has entry i + 1."""
        self.known, self.met = pa.array([], pa.string()), np.zeros(0, bool)
        self.ends, self.pool = np.zeros(2, np.int32), np.zeros(0, np.uint32)

    def forget_rare(self) -> None:
        """Keeps the pieces that were met in a later batch, if they take less than half of the memory, and none otherwise."""
        known, ids = self.known.filter(pa.array(self.met)), self._ids(np.flatnonzero(self.met) + 1)
        sizes = np.diff(self.ends)[1:][self.met]
        self.forget()
        if 2 * (known.nbytes + 4 * len(known) + ids.nbytes) < self.remembered:
            self._add(ids, sizes)
            self.known, self.met = known, np.zeros(len(known), bool)

    def _ids(self, entries: np.ndarray) -> np.ndarray:
        """ids of these entries, one after another."""
        return pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.pool)).take(pa.array(entries)).flatten().to_numpy()

    def _joined(self, entries: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """New entries, each of the ids of those from one place in begins up to the next."""
        return self._add(self._ids(entries), np.add.reduceat(np.diff(self.ends)[entries], begins))

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries for pieces of these sizes; returns their numbers."""
        first = len(self.ends) - 1
        self.ends = np.concatenate([self.ends, (self.ends[-1] + np.cumsum(sizes)).astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids])
        return np.arange(first, first + len(sizes))

    def _entries(self, pieces: pa.StringArray) -> np.ndarray:
        """Entries of distinct pieces."""
        if self.known.nbytes + self.ends.nbytes + self.pool.nbytes > self.remembered:
            self.forget_rare()
        found = pc.index_in(self.known, value_set=pieces)  # this way round, what is known goes into no hash table
        again = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        at = np.zeros(len(pieces), np.int64)
        at[found.drop_null().to_numpy()] = again + 1
        self.met[again] = True
        new = np.flatnonzero(at == 0)
        if len(new):
            fresh = pieces.take(pa.array(new))
            ids, sizes, order = self.words(fresh.to_pylist())
            at[new[order]] = self._add(ids, sizes)
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(order))])
            self.met = np.append(self.met, np.zeros(len(new), bool))
        return at

    def _tailed(self, pieces: pa.StringArray) -> tuple[np.ndarray, tuple[int, int]]:
        """Entries as of ``_entries``; those of words with tails are made of the word's and the tail's, and lie
        beyond what is remembered, of which the second result gives the lengths."""
        if not self.tails:
            return self._entries(pieces), (len(self.ends), len(self.pool))
        words = pc.utf8_rtrim(pieces, characters=self.tails)
        cut = pc.and_(pc.not_equal(words, pieces), pc.match_substring_regex(words, LETTERS + "$"))
        where = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        coded = pc.if_else(cut, words, pieces).dictionary_encode()
        at = self._entries(coded.dictionary)[coded.indices.to_numpy()]
        kept = len(self.ends), len(self.pool)
        if len(where):
            sized, tail = pc.subtract(pc.binary_length(pieces), pc.binary_length(words)).to_numpy()[where], np.zeros(len(where), np.int64)
            for n in np.unique(sized).tolist():  # tails of a length
                some = np.flatnonzero(sized == n)
                ends = pc.utf8_slice_codeunits(pieces.take(pa.array(where[some])), -n).dictionary_encode()
                own = [self.whole(x) for x in ends.dictionary.to_pylist()]
                tail[some] = self._add(np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own)))[ends.indices.to_numpy()]
            at[where] = self._joined(np.column_stack([at[where], tail]).reshape(-1), np.arange(0, 2 * len(where), 2))
        return at, kept

    def _lined(self, pieces: pa.StringArray) -> tuple[np.ndarray, tuple[int, int]]:
        """Entries as of ``_tailed``; those of pieces of several lines are made of the lines', each but the first with its break."""
        broken = np.flatnonzero(pc.match_substring(pieces, "\n").to_numpy(zero_copy_only=False)) if self.lines else []
        if not len(broken):
            return self._tailed(pieces)
        split = pc.split_pattern(pieces.take(pa.array(broken)), "\n")
        lines, begins = split.flatten(), split.offsets.to_numpy()[:-1].astype(np.int64)
        white = pc.or_(pc.equal(lines, ""), pc.not_equal(pc.utf8_trim(lines, characters=WHITE), lines)).to_numpy(zero_copy_only=False)
        parted = ~np.logical_or.reduceat(white, begins)  # a break beside white space may share a token with it
        if not parted.any():
            return self._tailed(pieces)
        counts = np.diff(split.offsets.to_numpy())
        first = np.zeros(len(lines), bool)
        first[begins] = True
        lines = pc.if_else(pa.array(first), lines, pc.binary_join_element_wise("\n", lines, "")).filter(pa.array(np.repeat(parted, counts)))
        rest = np.ones(len(pieces), bool)
        rest[broken[parted]] = False
        whole = pieces.filter(pa.array(rest))
        coded = pa.concat_arrays([whole, lines]).dictionary_encode()
        some, kept = self._tailed(coded.dictionary)
        some = some[coded.indices.to_numpy()]
        at = np.empty(len(pieces), np.int64)
        at[rest] = some[: len(whole)]
        at[broken[parted]] = self._joined(some[len(whole) :], np.cumsum(counts[parted]) - counts[parted])
        return at, kept

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (null: none) and, one more than texts, where each begins."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.cuts:
            parts = [self.whole(x.as_py()) for x in texts]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
        split = pc.split_pattern(texts, " ")
        heads = split.offsets.to_numpy().astype(np.int64)
        heads, counts = heads[:-1] - heads[0], np.diff(heads)
        coded = split.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        # the first piece of a text has no space before it; elsewhere a piece that starts blank is unsafe
        blank = pc.is_in(pc.utf8_slice_codeunits(distinct, 0, 1), pa.array(["", *WHITE])).to_numpy(zero_copy_only=False)
        unsafe = blank[codes]
        unsafe[heads] = False
        odd = np.add.reduceat(unsafe, heads) > 0 if len(texts) else np.zeros(0, bool)
        entry = np.zeros(len(distinct), np.int64)
        entry[~blank], kept = self._lined(distinct.filter(pa.array(~blank)))
        at = entry[codes]
        if odd.any():
            at[np.repeat(odd, counts)] = 0
        own = [self.whole((texts[i] if o else distinct[c]).as_py()) for i, (o, c) in enumerate(zip(odd.tolist(), codes[heads].tolist(), strict=True))]
        at[heads] = self._add(np.concatenate([np.zeros(0, np.uint32), *own]), np.fromiter(map(len, own), np.int64, len(own)))
        found = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.pool)).take(pa.array(at))
        ids, begins = found.flatten().to_numpy(), found.offsets.to_numpy().astype(np.int64)
        self.ends, self.pool = self.ends[: kept[0]], self.pool[: kept[1]]
        return ids, begins[np.append(heads, len(at))] - begins[0]


def text_batches(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many bytes in a text column, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


@lru_cache(maxsize=1)
def library_encoder(path: str) -> TextEncoder:
    """By a byte-level file of the tokenizers library, without special tokens being added."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    spaced = np.zeros(model.get_vocab_size() + 1, bool)
    for token, i in model.get_vocab().items():
        spaced[i] = token.startswith("Ġ")  # byte 20 in a byte-level vocabulary
    merged = model.model.tokenize  # for letters, which its pattern keeps whole: only the merges of the byte alphabet
    alphabet = [byte_letter(b) for b in range(256)]
    added = list(model.get_added_tokens_decoder().values())
    tails = "".join(t for t in TAILS if not any(t in x.content for x in added))
    lines = not any("\n" in x.content or x.lstrip or x.rstrip for x in added)
    top = BEYOND if model.normalizer is None else "\x80"

    def encoded(text: str) -> list[int]:
        return model.encode_batch_fast([text], add_special_tokens=False)[0].ids

    line = encoded("\n")

    def words(pieces: list[str]) -> Encoded:
        ids, sizes, order = [], [], [i for i, x in enumerate(pieces) if x.isascii() and x.isalpha()]
        for k in range(0, len(order), 4096):  # a token of the library is an object
            found = [merged("Ġ" + pieces[i]) for i in order[k : k + 4096]]
            ids += [t.id for own in found for t in own]
            sizes += map(len, found)
        others = []
        for i, x in enumerate(pieces):
            if x.isascii() and x.isalpha():
                continue
            letters = x[1:] if x[0] == "\n" else x
            plain = letters.isascii()
            if not letters.isalpha() or not plain and max(letters) >= top:
                others.append(i)
                continue
            letters = letters if plain else letters.encode().decode("latin-1").translate(alphabet)
            own = line + [t.id for t in merged(letters)] if x[0] == "\n" else [t.id for t in merged("Ġ" + letters)]
            ids += own
            sizes.append(len(own))
            order.append(i)
        begun = [i for i in others if pieces[i][0] == "\n"]
        for own in map(encoded, (pieces[i] for i in begun)):
            ids += own
            sizes.append(len(own))
        others = [i for i in others if pieces[i][0] != "\n"]
        for k in range(0, len(others), 512):  # one string for many pieces: each starts where a token has the space
            some = [pieces[i] for i in others[k : k + 512]]
            own = encoded(" " + " ".join(some))
            starts = np.flatnonzero(spaced[own])
            if len(starts) == len(some):
                sizes += np.diff(np.append(starts, len(own))).tolist()
            else:
                parts = [encoded(" " + x) for x in some]
                own = [i for x in parts for i in x]
                sizes += map(len, parts)
            ids += own
        return np.array(ids, np.uint32), np.array(sizes, np.int64), np.array(order + begun + others, np.int64)

    return TextEncoder(lambda text: np.array(encoded(text), np.uint32), words, tails=tails, lines=lines)


def byte_letter(byte: int) -> str:
    """The character that stands for a byte in a byte-level vocabulary: itself where it shows, else the next from U+0100."""
    shows = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(byte if byte in shows else 256 + sum(b not in shows for b in range(byte)))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with give_back() at the end of each task and freed memory returned after each batch it takes."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            return_freed()

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(trimmed(batches))
        finally:
            give_back()

    return tidy


def give_back() -> None:
    """Returns to the system what a task's buffers leave in this worker's allocators."""
    gc.collect()
    return_freed()


def return_freed() -> None:
    """Returns to the system what is free in this worker's allocators; looks for no cycles."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


@lru_cache(maxsize=1)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
