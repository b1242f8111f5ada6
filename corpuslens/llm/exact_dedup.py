"""Exact deduplication: 128-bit content hash, then the bytes themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, broadcast_if_small, is_small, keep_one, row_key, text_or_empty, written


def exact_duplicates(docs: DataFrame, *, keep: str = "largest", content_hash: Callable[[Column], Column] = row_key, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with
    the largest (or smallest) doc_id stays. Rows that repeat both id and text tie: one of them stays.
    Rows without an id stay only if their whole group has none. An empty table gives an empty table.
    Other columns of docs are ignored. A text of any length is hashed whole, and compared whole where
    its hash repeats.

    1. Ids and hashes go to a narrow table, whose hashes are counted with map-side combining.
    2. Only texts whose hash occurs twice are shuffled, grouped by (hash, text): grouping compares
       bytes, and each task sends one row for each of its distinct texts, so a group that holds a
       third of all rows is a few rows from each task. If the repeated hashes are too many to
       broadcast, all texts take this way and nothing else changes.
    3. The narrow rows get the size and survivor of their group. Groups in which the bytes split a
       hash (a collision) are joined by text instead.
    """
    top = F.max if keep == "largest" else F.min
    text = text_or_empty()
    bodies = docs.select("doc_id", text.alias("text"), content_hash(text).alias("h"))
    keys = written(docs.select("doc_id", content_hash(text).alias("h"), F.sha2(text, 256).alias("sha")), "keys")
    again = written(keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    if is_small(again, broadcast_rows):
        bodies = bodies.join(F.broadcast(again), "h", "left_semi")
    texts = bodies.groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"), top("doc_id").alias("keep_id"))
    groups = written(
        texts.groupBy("h").agg(F.count(F.lit(1)).alias("variants"), F.max("n").alias("n"), F.max("keep_id").alias("keep_id")).where("n > 1 or variants > 1"),
        "groups",
    )
    whole, split = groups.where("variants = 1").drop("variants"), groups.where("variants > 1").select("h")
    collided = bool(split.take(1))
    rows = keys.join(split, "h", "left_anti") if collided else keys
    out = rows.join(broadcast_if_small(whole, broadcast_rows), "h", "left")
    if collided:
        own = docs.select("doc_id", text.alias("text"), content_hash(text).alias("h"), F.sha2(text, 256).alias("sha")).join(split, "h", "left_semi")
        mixed = texts.join(split, "h", "left_semi")
        out = out.unionByName(own.join(mixed, ["h", "text"]).select(*out.columns))
    out = out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("sha").alias("text_sha256"),
        F.col("h").alias("text_hash"),
    ).withColumn("kept", (F.col("group_size") == 1) | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    ties = out.where("kept and group_size > 1").groupBy("text_hash", "text_sha256").count().where("count > 1")
    if ties.take(1):
        first = Window.partitionBy("text_hash", "text_sha256", "kept").orderBy("doc_id")
        multi = out.where("group_size > 1").withColumn("kept", F.col("kept") & (F.row_number().over(first) == 1))
        out = out.where("group_size = 1").unionByName(multi)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "text_hash")


def drop_exact_duplicates(docs: DataFrame, *, keep: str = "largest", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each text, all columns as they were; see exact_duplicates."""
    verdicts = exact_duplicates(docs, keep=keep, broadcast_rows=broadcast_rows)
    groups = verdicts.where("group_size > 1").groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_key"))
    counts = groups.agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return keep_one(docs, written(counts.where("kept = 0 or n > 1"), "verdicts"), broadcast_rows)
