"""Streams of captures and touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_memory
from ..tables import folders, remove_folder, settle


def _start(df: DataFrame, checkpoint: str, mode: str = "append"):
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_gate(src: DataFrame, memory: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Captures (entry_id, repo_id, ts, kind, body) through the secret gate into dated memory; refused ones apart.

    A batch writes to folders of its own number, so a batch that runs again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read for either table
        append_memory(held, memory, str(number)).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        held.unpersist()

    return _start(src, checkpoint).foreachBatch(write).start()


def stream_digest(touches: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Touches of each path in tumbling windows, given out once a window is over."""
    windowed = touches.withWatermark("ts", delay).groupBy(F.window("ts", width), "repo_id", "path").agg(F.count(F.lit(1)).alias("touches"))
    return windowed.select(F.col("window.start").alias("start"), "repo_id", "path", "touches")


def stream_churn(touches: DataFrame, width: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    windowed = touches.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "repo_id", "path").agg(F.count(F.lit(1)).alias("touches"))
    return windowed.select(F.col("window.start").alias("start"), "repo_id", "path", "touches")


def stream_dedup(captures: DataFrame, key: str = "note_id", delay: str = "7 days") -> DataFrame:
    return captures.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stream_hotspots(touches: DataFrame, window: str = "3 months") -> DataFrame:
    """Touches (repo_id, path, ts) of each path by day, for update mode; the state of a day goes when no touch of it can count any more."""
    days = touches.withWatermark("ts", window).groupBy(F.window("ts", "1 day"), "repo_id", "path").agg(F.count(F.lit(1)).alias("touches"))
    return days.select("repo_id", "path", F.col("window.start").alias("start"), "touches")


def _newest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """The versions (batch, folder) of each bucket that batches up to one have written, oldest first."""
    found: dict[int, list[tuple[int, str]]] = {}
    for folder in folders(spark, f"{path}/batch=*/bucket=*"):
        batch, bucket = (int(x.split("=")[1]) for x in folder.split("/")[-2:])
        if before is None or batch < before:
            found.setdefault(bucket, []).append((batch, folder))
    return {bucket: sorted(versions) for bucket, versions in found.items()}


def keep_hotspots(days: DataFrame, path: str, checkpoint: str, window: str = "3 months", buckets: int = 64) -> StreamingQuery:
    """Keeps ``stream_hotspots`` as a table in buckets of paths; a batch writes the buckets anew whose paths it changes, and no other.

    A bucket's newest version counts. A batch reads versions of earlier batches only, so one that runs
    again gives the same; the version before the newest stays for that, older ones are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = settle(batch.withColumn("bucket", F.pmod(F.xxhash64("repo_id", "path"), F.lit(buckets)).cast("int")), "hot-changes")
        changed = [r.bucket for r in rows.select("bucket").distinct().collect()]  # so many at most
        held = _newest(spark, path, number)
        old = [held[b][-1][1] for b in changed if b in held]
        kept = rows
        if old:
            past = spark.read.schema(batch.schema).parquet(*old).join(rows, ["repo_id", "path", "start"], "left_anti")
            kept = past.withColumn("bucket", F.pmod(F.xxhash64("repo_id", "path"), F.lit(buckets)).cast("int")).unionByName(rows)
        last = rows.agg(F.max("start").alias("last"))
        kept = kept.join(F.broadcast(last)).where(F.col("start") > F.col("last") - F.expr(f"interval {window}")).drop("last")  # one row
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        for b in changed:
            for _, folder in held.get(b, [])[:-1]:
                remove_folder(spark, folder)

    return _start(days, checkpoint, "update").foreachBatch(write).start()


def read_hotspots(spark: SparkSession, path: str, window: str = "3 months") -> DataFrame:
    """repo_id, path, touches in the window that ends with the last day of all."""
    rows = spark.read.parquet(*[versions[-1][1] for versions in _newest(spark, path).values()])
    last = rows.agg(F.max("start").alias("last"))
    return rows.join(F.broadcast(last)).where(F.col("start") > F.col("last") - F.expr(f"interval {window}")).groupBy("repo_id", "path").agg(F.sum("touches").alias("touches"))


def stream_late_split(src: DataFrame, on_time: str, late: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """Events (ts, …) into their own day, or, behind the watermark or without a time, into a side table.

    The watermark of a batch is the greatest time of all batches before it, less the delay; none is late
    in the first. What a batch knows of times is written beside the checkpoint under its number, and a
    batch reads what earlier ones wrote, so one that runs again decides alike.
    """
    marks = f"{checkpoint}/marks"
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slots = [x for k in (1, 2) if number >= k for x in folders(spark, f"{marks}/slot={(number - k) % 3}")]
        past = spark.read.schema("batch long, high long").parquet(*slots).where(F.col("batch") < number).agg(F.max("high")).first()[0] if slots else None
        rows = batch.persist()  # read for either table
        mark = None if past is None else F.timestamp_micros(F.lit(past)) - F.expr(f"interval {delay}")
        is_late = F.col("ts").isNull() if mark is None else F.coalesce(F.col("ts") < mark, F.lit(True))
        rows.where(~is_late).withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{on_time}/batch={number}")
        rows.where(is_late).write.mode("overwrite").parquet(f"{late}/batch={number}")
        high = rows.agg(F.greatest(F.max(stamp), F.lit(past).cast("long")).alias("high"))
        high.select(F.lit(number).cast("long").alias("batch"), "high").write.mode("overwrite").parquet(f"{marks}/slot={number % 3}")
        rows.unpersist()

    return _start(src, checkpoint).foreachBatch(write).start()


def drain(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all there is and returns what it wrote."""
    query = _start(df, checkpoint).format("parquet").option("path", path).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
