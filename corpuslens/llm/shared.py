"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import BROADCAST_ROWS, broadcast_if_small, new_folder
from ..tables import settle as written

__all__ = ["BROADCAST_ROWS", "broadcast_if_small", "new_folder", "written"]  # of the library's tables, for this subpackage

#: The bytes that part words, for ``btrim`` and ``translate``: 20 and 09 to 0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most so many rows; counts no further."""
    return table.limit(rows + 1).count() <= rows


def lean_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lets no more than so many bytes of rows go to a Python worker at a time, from now on in this session.

    A session's default is 64 MB, which JVM and worker each hold several times over.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).rstrip("bB")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:].lower(), 1)
    held = int(now.rstrip("kmgKMG") or 0) * unit
    if not 0 < held <= size:
        spark.conf.set(key, str(size))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, however often then uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(docs: DataFrame, dropped: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows whose (doc_id, text) is in the written table dropped(drop_id, drop_key).

    drop_key is ``row_key()`` of the text, so rows that share an id but not a text stay apart. A
    small table is broadcast and no text is shuffled; a large one goes through a shuffled join.
    """
    side = broadcast_if_small(dropped, rows)
    key = row_key(docs["text"])
    return docs.join(side, docs["doc_id"].eqNullSafe(side["drop_id"]) & (key == side["drop_key"]), "left_anti")


def keep_one(docs: DataFrame, counts: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without what the written table counts(drop_id, drop_key, kept, n) drops.

    A row of counts says of how many rows n with this id and text any are kept; it has none of the
    rows that stay as they are. Rows that repeat both id and text can't be told apart by a key: of
    those with a kept one, the first stays.
    """
    left = without(docs, counts, rows)
    tied = counts.where("kept > 0")
    if not tied.take(1):
        return left
    same = docs.join(tied, docs["doc_id"].eqNullSafe(tied["drop_id"]) & (row_key(docs["text"]) == tied["drop_key"]), "left_semi")
    key = f"key_{'_'.join(docs.columns)}"
    return left.unionByName(same.withColumn(key, row_key(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key))


def row_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))
