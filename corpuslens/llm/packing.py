"""Packing documents into sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, lean_batches, written
from .vocab import library_encoder, text_batches, tidied


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size (1 to room), given in decreasing order, and the number of bins.

    A tournament tree holds at each inner node the most room of any bin below it, so the first bin
    that fits an item is found, and updated, in log n steps.
    """
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, room - tree[node]
        used = max(used, node - leaves + 1)
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets, used


def piece_digests(docs: DataFrame, vocabulary: str, *, length: int, end_id: int, with_ids: bool) -> DataFrame:
    """doc_id, doc_tokens, crcs (of each cut of length ids), and, if asked for, ids (binary) of each text and end_id."""
    schema = "doc_id long, doc_tokens long, crcs array<long>" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        for batch in (part for whole in batches for part in text_batches(whole, 1)):
            ids, bounds = encoder.encode(batch.column(1))
            raw = memoryview(np.insert(ids, bounds[1:], end_id).astype("<u4")).cast("B")
            step = (bounds + np.arange(len(bounds))).tolist()
            spans = list(zip(step[:-1], step[1:], strict=True))
            crcs = [[zlib.crc32(raw[4 * k : 4 * min(k + length, j)]) for k in range(i, j, length)] for i, j in spans]
            columns = [batch.column(0), pa.array([j - i for i, j in spans], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            if with_ids:
                columns.append(pa.array([bytes(raw[4 * i : 4 * j]) for i, j in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "crcs", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), schema)


def pack_documents(docs: DataFrame, vocabulary: str, *, length: int = 1024, end_id: int = 0, group_docs: int = 20_000, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids).

    A document (its ids and end_id) is cut every ``length`` ids from its start. Whole cuts are
    sequences of their own; the rests go first-fit decreasing into bins, in groups that a hash of the
    row and of its place in its task deals out, about group_docs documents each, so groups stay as large
    at every size of corpus, and rows that repeat, with an id or without, are dealt to all of them. Sequence ids and offsets have no gaps. A null text is end_id alone;
    repeated rows are packed each; a text of any length is encoded whole and cut; an empty table gives
    an empty table; other columns are ignored.
    """
    lean_batches(docs.sparkSession)
    groups = -(-docs.count() // group_docs) or 1
    rows = piece_digests(docs, vocabulary, length=length, end_id=end_id, with_ids=with_ids)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs", F.monotonically_increasing_id()), F.lit(groups)))
    layout = rows.select("*", *[F.lit(0).cast("long").alias(x) for x in ("first_whole", "rest_sequence", "rest_offset", "sequences")])

    def pack(table: pa.Table) -> pa.Table:
        n = table.column("doc_tokens").to_numpy()
        ids = table.column("doc_id").fill_null(-1).to_numpy()
        whole, rest = n // length, n % length
        order = np.lexsort((n, ids))
        first = np.empty(len(n), np.int64)
        first[order] = np.cumsum(whole[order]) - whole[order]
        some = np.flatnonzero(rest)
        some = some[np.lexsort((n[some], ids[some], -rest[some]))]
        bins, offsets, used = first_fit_decreasing(rest[some], length)
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        sequence[some], offset[some] = whole.sum() + bins, offsets
        new = {"first_whole": first, "rest_sequence": sequence, "rest_offset": offset, "sequences": np.full(len(n), whole.sum() + used)}
        return pa.table([pa.array(new[c]) if c in new else table.column(c) for c in table.column_names], names=table.column_names)

    packed = written(layout.groupBy("grp").applyInArrow(pack, layout.schema), "packed")
    sizes = packed.groupBy("grp").agg(F.max("sequences").alias("own"))  # a row for each group of documents
    sizes = written(sizes.withColumn("run", F.expr("grp div 1024")), "sizes")
    before = lambda w, by: w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.groupBy("run").agg(F.sum("own").alias("n"))  # a row for each 20 million documents
    runs = runs.select("run", F.coalesce(F.sum("n").over(before(Window.partitionBy(F.lit(0)), "run")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("own").over(before(Window.partitionBy("run"), "grp")), F.lit(0))
    base = sizes.withColumn("inside", inside).join(runs, "run").select("grp", (F.col("first") + F.col("inside")).alias("base"))
    pieces = packed.join(broadcast_if_small(written(base, "bases")), "grp").select("*", F.posexplode("crcs").alias("k", "ids_crc32"))
    start = F.col("k").cast("long") * length
    size = F.least(F.lit(length).cast("long"), F.col("doc_tokens") - start)
    is_whole = size == length
    out = [
        F.col("doc_id"),
        start.alias("start"),
        size.alias("length"),
        F.col("ids_crc32"),
        F.col("doc_tokens"),
        (F.col("base") + F.when(is_whole, F.col("first_whole") + F.col("k")).otherwise(F.col("rest_sequence"))).alias("sequence_id"),
        F.when(is_whole, F.lit(0)).otherwise(F.col("rest_offset")).cast("long").alias("offset"),
    ]
    if with_ids:
        out.append(F.expr(f"substring(ids, cast(4 * {length} * k + 1 as int), {4 * length})").alias("ids"))
    return pieces.select(*out)
