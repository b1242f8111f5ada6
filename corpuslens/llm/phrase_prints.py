"""Document fingerprints: least hashes of the phrases that a Lempel-Ziv parse finds in a text."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches, text_or_empty
from .vocab import tidied

#: Least hashes that a fingerprint keeps.
KEPT = 128
#: An odd factor of the hash of a phrase, its inverse modulo 2^64, and the factors that mix the bits of a 64-bit number.
FACTOR, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text whose phrases are hashed at a time.
STRETCH = 1 << 20


class Parse:
    """Phrases of one text, byte by byte: the longest known phrase and a byte make the next one."""

    def __init__(self) -> None:
        self.trie: dict[int, int] = {}  # a phrase's number + byte: the number of the longer phrase
        self.at = 0  # the number of the phrase that is being matched, 0 before its first byte

    def read(self, data: bytes, start: int = 0) -> tuple[list[int], list[int]]:
        """Keys of the new phrases in data and, counted from start, where each ends. A phrase's number is 256 times its end."""
        keys, ends, at, trie, known, end = [], [], self.at, self.trie, self.trie.get, start
        for byte in data:
            end += 1
            key = at + byte
            at = known(key)
            if at is None:
                trie[key] = end << 8
                keys.append(key)
                ends.append(end)
                at = 0
        self.at = at
        return keys, ends

    def forget(self, keys: list[int], at: int) -> None:
        """Undoes what was read since the phrase at was being matched."""
        for key in keys:
            del self.trie[key]
        self.at = at


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of INVERSE from 0 to STRETCH, modulo 2^64."""
    out = []
    for base in (FACTOR, INVERSE):
        row = np.full(STRETCH + 1, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def phrase_hashes(data: bytes, ends: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the bytes of each phrase; phrases follow each other from the first byte on.

    A phrase's polynomial in FACTOR is a difference of running sums, divided by the power at its start.
    """
    up, down = powers()
    out, first, start = [np.zeros(0, np.uint64)], 0, 0
    while first < len(ends):
        last = max(int(np.searchsorted(ends, start + STRETCH, "right")), first + 1)
        own = ends[first:last] - start
        if own[-1] > STRETCH:  # one phrase of more than a stretch
            digest = hashlib.blake2b(data[start : start + int(own[-1])], digest_size=8).digest()
            out.append(np.frombuffer(digest, np.uint64))
        else:
            values = np.frombuffer(data, np.uint8, int(own[-1]), start).astype(np.uint64) + np.uint64(1)
            sums = np.append(np.uint64(0), np.cumsum(values * up[: len(values)]))
            begins = np.append(0, own[:-1])
            out.append((sums[own] - sums[begins]) * down[begins])
        start, first = start + int(own[-1]), last
    x = np.concatenate(out)
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return (x >> np.uint64(32)).astype(np.uint32)


def fingerprint(data: bytes, ends: list[int], kept: int = KEPT) -> np.ndarray:
    """The least distinct hashes of the phrases, ascending; all of them if there are no more."""
    hashes = phrase_hashes(data, np.array(ends, np.int64))
    if len(hashes) > 4 * kept:
        hashes = np.partition(hashes, 2 * kept)[: 2 * kept]
    return np.unique(hashes)[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of the least hashes of both sets together that are in each: an estimate of the sets' Jaccard similarity."""
    every = np.concatenate((a, b))
    every.sort()
    twice = every[1:] == every[:-1]
    both = every[np.append(True, ~twice)[: len(every)]][:kept]
    return int(np.searchsorted(every[1:][twice], both[-1], "right")) / len(both) if len(both) else 1.0


def written_out(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


class Head(NamedTuple):
    """A document's place in the order: descending id, rows without one last, then a hash of the text."""

    missing: bool
    negative_id: int
    text_hash: int


def heads_of_runs(docs: DataFrame, runs: int) -> list[Head]:
    """The first place of each run of a sort of all documents, at most so many."""
    keys = docs.select(F.col("doc_id").isNull().alias("missing"), F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit(0)).alias("negative_id"), F.xxhash64(text_or_empty()).alias("text_hash"))
    dealt = keys.repartitionByRange(runs, *keys.columns).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*keys.columns)).alias("head"))
    return sorted(Head(r.head.missing, int(r.head.negative_id), r.head.text_hash) for r in dealt.collect())  # a row for each partition


def in_runs(docs: DataFrame, heads: list[Head]) -> DataFrame:
    """run, doc_id, text, guest: each document in its run, in order, and after it as guest the head of the next run (of the first, after the last)."""

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series, text_hash: pd.Series) -> pd.Series:
        out = []
        for i, h in zip(doc_id, text_hash, strict=True):
            here = Head(i is None or i != i, 0 if i is None or i != i else -int(i), h)
            run = bisect.bisect_right(heads, here) - 1
            out.append([run, (run - 1) % len(heads)] if heads[run] == here else [run])
        return pd.Series(out)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.select("doc_id", "text", "text_hash", F.posexplode(places(F.col("doc_id").cast("decimal(20,0)"), "text_hash")).alias("guest", "run"))
    order = [F.col("run"), F.col("guest"), F.desc_nulls_last("doc_id"), F.col("text_hash")]
    return rows.repartitionById(len(heads), F.col("run")).sortWithinPartitions(*order).select("run", "doc_id", "text", "guest")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def printer(kept: int):
    """For mapInArrow over runs: reads one text ahead, so that each text is parsed once, and its edited end in addition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # run, doc_id, text, guest of the row before
        before = None  # what is known of the row before that, and its fingerprint
        done: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if waiting:
                    before = taken(waiting, row, before, done)
                waiting = row
            yield table(done)
            done = []
        if waiting:
            taken(waiting, None, before, done)
        yield table(done)

    def table(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * 7
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    def taken(row: tuple, following: tuple | None, before: tuple | None, done: list[tuple]) -> tuple | None:
        """Fingerprints a row, which completes the row before it; returns what is known of this one."""
        own_run, doc_id, text, guest = row
        if guest and before is None:  # a second row that equals the head of the next run
            return None
        n = len(text)
        data, parse = text.encode(), Parse()
        edit = not guest and following is not None
        cut = len(text[: n - n // 3].encode())
        keys, ends = parse.read(data[:cut])
        known = None
        if edit:
            at = parse.at
            tail = following[2][: n // 3].encode()
            keys, more = parse.read(tail, cut)
            edited = data[:cut] + tail
            other = fingerprint(edited, ends + more, kept)
            parse.forget(keys, at)
            known = (doc_id, n, hashlib.sha256(edited).hexdigest(), other)
        _, more = parse.read(data[cut:], cut)
        own = fingerprint(data, ends + more, kept)
        if before:
            last_id, chars, digest, edited_print, print_ = before
            done.append((last_id, chars, digest, written_out(print_), written_out(edited_print), likeness(print_, edited_print, kept), likeness(print_, own, kept)))
        return (*known, own) if known else None

    return tidied(run)


def phrase_fingerprints(docs: DataFrame, *, kept: int = KEPT) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    A whole text's UTF-8 bytes are parsed into phrases, each the longest phrase known so far and one byte
    more; the fingerprint is the ``kept`` least of their 32-bit hashes, ascending, eight hex digits each
    (fewer if there are fewer phrases). Likeness is the share of the least hashes of two fingerprints
    together which are in both. The edited text has the first n // 3 code points of the next document, by
    descending id, in place of its last n // 3; its parse goes on from the common part, without copies.

    Documents are dealt once into sorted runs, each with the first document of the next run behind it;
    runs are streams, so a task holds two texts and one text's phrases. What the driver collects is the
    first place of each run.

    A null or empty text has the empty fingerprint, which is alike (1) to another empty one and unlike (0)
    to all others. Rows without an id come last, equal ids are ordered by a hash of their texts; rows that
    repeat are fingerprinted each and follow each other. A single document follows itself. An empty table
    gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    heads = heads_of_runs(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    return in_runs(docs, heads).mapInArrow(printer(kept), SCHEMA)
