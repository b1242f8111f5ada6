"""What is written back: snapshots, reports, gated memory and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators.secrets import secret_kinds


def write_index(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """One table for each abstraction, in folders by a hash of repo_id."""
    for name, df in tables.items():
        bucketed = df.withColumn("repo_bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int"))
        bucketed.repartition("repo_bucket", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(8))).write.mode("overwrite").partitionBy("repo_bucket").parquet(f"{path}/{name}")


def split_entries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (entry_id, body, …) that may be written, and entry_id with kinds of those refused.

    Empty entries are refused as ``empty``; a secret is refused and never cleaned away. The verdict is
    a column of the row, so rows without an id or with one id are each written or refused once.
    """
    blank = F.regexp_replace(F.coalesce("body", F.lit("")), r"\s", "") == ""
    judged = df.withColumn("refused__", F.when(blank, F.array(F.lit("empty"))).otherwise(secret_kinds("body")))
    return judged.where("size(refused__) = 0").drop("refused__"), judged.where("size(refused__) > 0").select("entry_id", F.col("refused__").alias("kinds"))


def append_memory(df: DataFrame, path: str, batch: str) -> DataFrame:
    """Writes clean entries (entry_id, repo_id, ts, kind, body) to folders of repository and day under path/batch=…; returns the refused ones.

    A batch that is written again replaces what it wrote; others stay.
    """
    clean, refused = split_entries(df)
    placed = clean.withColumns({"repo": F.col("repo_id"), "day": F.to_date("ts")}).hint("rebalance", "repo", "day")  # a file or so for each folder
    placed.write.mode("overwrite").partitionBy("repo", "day").parquet(f"{path}/batch={batch}")
    return refused


#: Where captures lie among a batch's folders.
PLACE = ["team", "slug", "day"]


def route_captures(df: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Where each capture (ts, content, project, tags, team, note_id, profile) goes, what is written there, and whether it may leave.

    A team's capture is a note of its own, ``team/<team>/projects/<project or inbox>/<day>-<note_id>.md``;
    any other is a line of its project's note or of the day's inbox. An empty team or project is none.
    A sealed profile writes as well, but pushes nothing, which the note of a team's capture says.
    """
    spark = df.sparkSession
    policy = profiles if profiles is not None else spark.createDataFrame(rules.PROFILES, "profile string, refuses string, outward boolean")
    day, team, slug = C.day_stamp("ts"), C.slug(F.nullif("team", F.lit(""))), C.slug(F.nullif("project", F.lit("")))
    dest = (
        F.when(team.isNotNull(), F.concat(F.lit("team/"), team, F.lit("/projects/"), F.coalesce(slug, F.lit("inbox")), F.lit("/"), day, F.lit("-"), "note_id", F.lit(".md")))
        .when(slug.isNotNull(), F.concat(F.lit("projects/"), slug, F.lit(".md")))
        .otherwise(F.concat(F.lit("inbox/"), day, F.lit(".md")))
    )
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), C.slug(t))), " ")
    said = F.concat(F.coalesce("content", F.lit("")), F.when(tags != "", F.concat(F.lit(" "), tags)).otherwise(""))
    head = F.concat(F.lit("---\ntype: brain-note\ncreated: "), day, F.lit("\n---\n"))
    text = F.when(team.isNotNull(), F.concat(head, F.lit("\n"), said, F.lit("\n"))).otherwise(F.concat(F.lit("\n- "), day, F.lit(" — "), said, F.lit("\n")))
    joined = df.join(F.broadcast(policy), "profile", "left").withColumn("sealed", ~F.coalesce("outward", F.lit(True)))
    pushed, refused = team.isNotNull() & ~F.col("sealed"), F.when(team.isNotNull() & F.col("sealed"), "outward_sync_disabled")
    return joined.select(*df.columns, dest.alias("dest"), tags.alias("tag_line"), text.alias("written"), pushed.alias("pushed"), refused.alias("note"))


def write_captures(df: DataFrame, path: str, batch: str, profiles: DataFrame | None = None) -> DataFrame:
    """Writes routed captures to path/batch=…, in folders of team, project and day; returns the routed rows.

    All destinations are one write. A batch that is written again replaces its own folder and no other,
    so nothing is appended twice; ``read_captures`` lets the earliest batch's note of a name stand.
    """
    routed = route_captures(df, profiles)
    folder = lambda c, none: F.coalesce(C.slug(F.nullif(c, F.lit(""))), F.lit(none))
    placed = routed.select("dest", "written", "ts", "note_id", F.col("team").isNotNull() & (F.col("team") != ""), folder("team", "own"), folder("project", "inbox"), C.day_stamp("ts"))
    placed.toDF("dest", "written", "ts", "note_id", "own_note", *PLACE).write.mode("overwrite").partitionBy(*PLACE).parquet(f"{path}/batch={batch}")
    return routed


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """dest, text of each note: a team's by the first capture of that name, others by all their lines in order of time."""
    schema = "dest string, written string, ts timestamp, note_id string, own_note boolean, batch string, team string, slug string, day string"
    rows = spark.read.schema(schema).parquet(path)
    first = rows.where("own_note").groupBy("dest").agg(F.min_by("written", F.struct("batch", "ts", "written")).alias("text"))
    lines = rows.where("not own_note").groupBy("dest").agg(F.array_sort(F.collect_list(F.struct("ts", "batch", "note_id", "written"))).alias("x"))
    head = F.concat(F.lit("---\ntype: brain-note\ncreated: "), C.day_stamp(F.col("x")[0]["ts"]), F.lit("\n---\n"))
    return first.unionByName(lines.select("dest", F.concat(head, F.array_join(F.transform("x", lambda r: r["written"]), "")).alias("text")))
