"""Token-id files: Huffman-coded blocks with bit-offset checkpoints, in the order of doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .huffman import canonical_codes, code_lengths, decode_block, decode_table, encode_block
from .shared import lean_batches, written
from .vocab import library_encoder, text_batches, tidied

MAX_BITS = 18
#: Ids between two checkpoints, and ids after which a block ends (with the document that reaches them).
EVERY, BLOCK_IDS = 128, 1 << 18
#: Bytes of text that are encoded together.
TEXT_BYTES = 4 << 20

BLOCKS = "part int, block int, first long, doc_ids array<long>, n_tokens array<long>, n_ids long, checkpoints binary, payload binary"


def is_wide(vocabulary: str, end_id: int) -> bool:
    """Whether an id of the vocabulary, or end_id, needs more than 16 bits."""
    from tokenizers import Tokenizer

    return max(end_id, max(Tokenizer.from_file(vocabulary).get_vocab().values(), default=0)) >= 1 << 16


def document_ids(docs: DataFrame, vocabulary: str, end_id: int, wide: bool) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 16 bits, or 32 if wide) of each text with end_id after it."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        for batch in (part for whole in batches for part in text_batches(whole, 1, TEXT_BYTES)):
            ids, bounds = encoder.encode(batch.column(1))
            with_end = np.insert(ids, bounds[1:], end_id).astype(kind)
            step = bounds + np.arange(len(bounds))
            width = with_end.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(step * width), pa.py_buffer(with_end)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(step)), data.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids binary")


def id_counts(ids: DataFrame, wide: bool) -> np.ndarray:
    """How often each id occurs: one row for each id and task is shuffled; a vocabulary's counts come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4" if wide else "<u2"))
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, max_bits: int = MAX_BITS, every: int = EVERY, block_ids: int = BLOCK_IDS) -> None:
    """Writes path/code (id, bits) and path/blocks, whose parts follow each other in doc_id order.

    A block holds whole documents, so a document of any length is one piece; each block is decoded
    by itself, and within it each run of ``every`` ids from its checkpoint. Null texts count as
    empty; rows without an id come first; repeated rows are all written, equal ids in the order of
    their tokens. An empty table gives files without blocks. Other columns are ignored. Ids go as 16
    bits before they are coded, or as 32 where the vocabulary has larger ones.

    Texts are encoded once and not shuffled: what is range partitioned by doc_id are the ids.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    wide = is_wide(vocabulary, end_id)
    ids = written(document_ids(docs, vocabulary, end_id, wide), "ids")
    bits = code_lengths(id_counts(ids, wide), max_bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    codes = canonical_codes(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("checkpoints", pa.binary()), ("payload", pa.binary())])
        part, block, first, held, owners, sizes = TaskContext.get().partitionId(), 0, 0, [], [], []

        def packed() -> pa.RecordBatch:
            data = np.concatenate(held)
            payload, marks = encode_block(data, codes, bits, every)
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (part, block, first, owners, sizes, len(data), marks, payload), strict=True))], schema)

        waiting = 0
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(x.as_py(), "<u4" if wide else "<u2")
                held.append(own)
                owners.append(doc_id)
                sizes.append(len(own))
                waiting += len(own)
                if waiting >= block_ids:
                    yield packed()
                    block, first, waiting, held, owners, sizes = block + 1, first + waiting, 0, [], [], []
        if held:
            yield packed()

    ordered = ids.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(tidied(run), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, *, max_bits: int = MAX_BITS, every: int = EVERY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as 32 bits) of each document of write_token_files.

    The code and the token totals of the parts (one number for each) come to the driver.
    """
    code = spark.read.parquet(f"{path}/code").collect()
    bits = np.zeros(max((r["id"] for r in code), default=-1) + 1, np.uint8)
    for r in code:
        bits[r["id"]] = r["bits"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    before, total = {}, 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect()):
        before[part], total = total, total + n
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(bits, max_bits)
        for batch in batches:
            for k in range(batch.num_rows):
                part, first, n_ids = (batch.column(i)[k].as_py() for i in (0, 1, 4))
                sizes = np.array(batch.column(3)[k].as_py(), np.int64)
                ids = decode_block(batch.column(6)[k].as_py(), batch.column(5)[k].as_py(), n_ids, table, max_bits, every)
                raw, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(sizes)
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [batch.column(2)[k].values, before[part] + first + ends - sizes, sizes, [zlib.crc32(x) for x in own], [bytes(x) for x in own] if with_ids else []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(names)], kinds, strict=False)], names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.select("part", "first", "doc_ids", "n_tokens", "n_ids", "checkpoints", "payload").mapInArrow(tidied(run), schema)
