"""Vector code compression: each part of a vector as the nearest entry of a small codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, lean_batches, written
from .vocab import tidied

#: A subtree of no more leaves than this is finished level by level, all its nodes of a level at once.
SUBTREE = 4096
#: Scaled components stay within this, so that a vector's squared distance fits 64 bits.
LARGEST = 1 << 26

Books = np.ndarray  # (parts, entries, width), integers


def nearest(parts: np.ndarray, book: np.ndarray, subtree: int = SUBTREE) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (ties: the lower) and its squared distance; parts are distinct, in lexicographic order.

    The parts are the leaves of a trie: depth-first, a node adds its component's squared distances from
    all entries to the vector that its parent has accumulated, so parts share the sums of their common
    prefixes. Recursion ends at subtrees of so many leaves, whose nodes of one level are added together.
    """
    entry, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    width = parts.shape[1]

    def visit(lo: int, hi: int, depth: int, gathered: np.ndarray) -> None:
        """Leaves lo to hi share their first depth components, whose distances are gathered."""
        while depth < width and hi - lo > subtree:
            column = parts[lo:hi, depth]
            starts = np.flatnonzero(np.diff(column, prepend=column[0] - 1))
            below = gathered + (column[starts][:, None] - book[:, depth]) ** 2
            if len(starts) > 1:
                begin = 0  # children are visited in runs of at most a subtree, or alone
                bounds = np.append(starts, hi - lo)
                while begin < len(starts):
                    end = max(int(np.searchsorted(bounds, bounds[begin] + subtree, "right")) - 1, begin + 1)
                    if end == begin + 1:
                        visit(lo + bounds[begin], lo + bounds[end], depth + 1, below[begin])
                    else:
                        levels(lo + bounds[begin], lo + bounds[end], depth, gathered)
                    begin = end
                return
            gathered, depth = below[0], depth + 1
        levels(lo, hi, depth, gathered)

    def levels(lo: int, hi: int, depth: int, gathered: np.ndarray) -> None:
        some = parts[lo:hi]
        node = np.zeros(hi - lo, np.int64)  # of each leaf, at the level reached
        sums = gathered[None, :]
        new = np.zeros(hi - lo, bool)
        for d in range(depth, width):
            new[1:] |= some[1:, d] != some[:-1, d]
            starts = np.flatnonzero(np.append(True, new[1:]))
            sums = sums[node[starts]] + (some[starts, d][:, None] - book[:, d]) ** 2
            node = np.cumsum(new)
        at = np.argmin(sums, axis=1)
        entry[lo:hi], distance[lo:hi] = at[node], sums[np.arange(len(sums)), at][node]

    if len(parts):
        visit(0, len(parts), 0, np.zeros(len(book), np.int64))
    return entry, distance


def as_keys(parts: np.ndarray) -> pa.Array:
    """Rows of integers as bytes that sort as they do."""
    raw = (parts + (1 << 31)).astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(4 * parts.shape[1]), len(parts), [None, pa.py_buffer(raw)]).cast(pa.binary())


def of_keys(keys: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(keys.to_pylist())
    return np.frombuffer(raw, ">u4").reshape(len(keys), width).astype(np.int64) - (1 << 31)


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, how often each occurs, and which one each row is."""
    order = np.lexsort(parts.T[::-1])
    inner = parts[order]
    new = np.append(True, (inner[1:] != inner[:-1]).any(axis=1))[: len(parts)]
    which = np.empty(len(parts), np.int64)
    which[order] = np.cumsum(new) - 1
    return inner[new], np.bincount(which, minlength=int(new.sum())), which


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has only finite components."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.col(column).isNotNull() & finite)


def scaled(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    """(vectors, parts, width) of integers."""
    sizes = pc.list_value_length(column).to_numpy()
    flat = np.floor(column.flatten().to_numpy().astype(np.float64) * scale)
    if len(sizes) and ((sizes != sizes[0]).any() or sizes[0] % parts or not sizes[0]):
        raise ValueError(f"vectors must have equal lengths, a multiple of {parts}")
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"components must be within {LARGEST / scale:,.0f} of zero")
    return flat.astype(np.int64).reshape(len(sizes), parts, sizes[0] // parts if len(sizes) else 0)


def distinct_parts(rows: DataFrame, scale: int, parts: int) -> DataFrame:
    """part, key (bytes in lexicographic order) and times, sorted through files: each file is a run of leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = scaled(batch.column(0), scale, parts)
            for k in range(parts if len(cut) else 0):
                leaves, times, _ = distinct(cut[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaves), k, np.int32)), as_keys(leaves), pa.array(times, pa.int64())], ["part", "key", "times"])

    found = rows.mapInArrow(tidied(run), "part int, key binary, times long").groupBy("part", "key").agg(F.sum("times").alias("times"))
    return written(found.repartitionByRange("part", "key").sortWithinPartitions("part", "key"), "parts")


def improve(table: DataFrame, books: Books) -> Books:
    """One round over the distinct parts: assign, then move each used entry to the floor of its parts' mean."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            part, times = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            leaves = of_keys(batch.column(1), width)
            for k in np.unique(part).tolist():
                own = part == k
                entry, _ = nearest(leaves[own], books[k])
                np.add.at(count[k], entry, times[own])
                np.add.at(sums[k], entry, leaves[own] * times[own][:, None])
        used = np.argwhere(count)
        if len(used):
            at = tuple(used.T)
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in at], pa.array(count[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = table.mapInArrow(tidied(run), "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    moved = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # a row for each entry at most
        moved[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return moved


def fit_codebooks(rows: DataFrame, first: np.ndarray, *, scale: int, rounds: int) -> Books:
    """rows: one column of usable vectors; first: the scaled vectors (entries, parts, width) that the codebooks start from."""
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    if not books.size or not rounds:
        return books
    table = distinct_parts(rows, scale, books.shape[0])
    for _ in range(rounds):
        books = improve(table, books)
    return books


def codebooks_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoder(books: Books, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the first column, vectors, becomes code and error; the others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = scaled(batch.column(0), scale, books.shape[0])
            codes, error = np.zeros(cut.shape[:2], np.uint8), np.zeros(len(cut), np.int64)
            for k in range(books.shape[0] if len(cut) else 0):
                leaves, _, which = distinct(cut[:, k])
                entry, distance = nearest(leaves, books[k])
                codes[:, k] = entry[which]
                error += distance[which]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error), *batch.columns[1:]], ["code", "error", *batch.schema.names[1:]])

    return tidied(run)


def compress_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable vector.

    A component x is the integer floor(scale * x); a vector is cut into equal parts, each with a codebook
    of at most 256 entries, which starts as that part of the vectors of the smallest ids and takes rounds
    of assigning (squared Euclidean distance, ties to the lower index) and moving (floor of the mean).
    Rounds run over the distinct parts with their multiplicities, sorted into files whose runs are tries;
    what comes to the driver is a row for each codebook entry. Vectors aren't shuffled to be encoded.

    Rows whose vector is null or holds a null, NaN or infinity are dropped. A null id is kept, after all
    others; rows that repeat are coded each, and among equal ids the smaller vector is the first. Fewer
    vectors than entries make smaller codebooks, none an empty table. Null labels are one label. Vectors of
    unequal lengths, of a length that isn't a multiple of parts, or with scaled components beyond 2^26,
    whose errors 64 bits may not hold, are an error. Extra columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has a byte for each part")
    lean_batches(vectors.sparkSession)
    kept = usable(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")), "vector")
    first = [r.vector for r in kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()]
    books = fit_codebooks(kept.select("vector"), scaled(pa.array(first, pa.list_(pa.float64())), scale, parts), scale=scale, rounds=rounds)
    kinds = dict(kept.dtypes)
    coded = kept.select("vector", "vec_id", "label").mapInArrow(encoder(books, scale), f"code string, error long, vec_id {kinds['vec_id']}, label {kinds['label']}")
    coded = written(coded, "codes")
    sums = broadcast_if_small(written(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors"))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["of_label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
