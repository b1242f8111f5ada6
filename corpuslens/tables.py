"""Where intermediate tables go, and what may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of more rows than this is never broadcast (narrow rows, 8 to 40 MB).
BROADCAST_ROWS = 400_000
#: So many narrow rows are one task's share where a table is dealt by its size.
TASK_ROWS = 1_000_000

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or setCheckpointDir name it.

    Without one, a session on this machine alone takes a temporary folder; a cluster is an error, since
    its executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="corpuslens-")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of this application's in the shared folder that nothing uses yet; ``clear_tables`` removes what is put there."""
    return f"{shared_dir(spark)}/corpuslens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders whose path fits a pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [] if x.isDirectory())


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_tables(spark: SparkSession) -> None:
    """Removes the tables that this application has put in the shared folder; no frame that reads them works after it."""
    remove_folder(spark, f"{shared_dir(spark)}/corpuslens/{spark.sparkContext.applicationId}")


def shuffled(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: Spark takes the size of a file for that of its rows, which may be
    twenty times as much, and would send such a table through the driver."""
    return table.hint("merge")


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Into how many partitions so many rows are dealt, so that a task's share doesn't grow with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table, broadcast if it has at most so many rows, else left to a shuffled join."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
