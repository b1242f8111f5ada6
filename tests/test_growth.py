"""Registered queries on tables whose groups, keys or files differ from the given ones."""

import oracle
import pytest
from pyspark.sql import functions as F

from corpuslens.plans import registry


def most_rows(df) -> int:
    """The most rows that any node of the plan of a frame made, which was run before."""
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.fixture
def one_name(spark, sf_dir, tmp_path):
    """The given tables, but with 2,000 parts of one name that follow each other in one order of all."""
    for name in ("part", "lineitem"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        key = {"part": "p_partkey", "lineitem": "l_partkey"}[name]
        row = df.limit(1).crossJoin(spark.range(2000).withColumnRenamed("id", "n"))
        row = row.withColumn(key, F.col("n").cast(df.schema[key].dataType))
        if name == "lineitem":
            for c, v in (("l_orderkey", F.floor(F.col("n") / 100)), ("l_linenumber", F.col("n") % 100)):
                row = row.withColumn(c, v.cast(df.schema[c].dataType))
        row.select(df.columns).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["coverage_names", "impact_unverified", "impact_unverified_whole", "suggested_tests"])
def test_parts_and_tests_of_one_name_are_not_paired(spark, one_name, name):
    """200 tests and 1,800 parts of one name are 360,000 pairs."""
    df = registry.QUERIES[name](spark, one_name)
    assert oracle.differences(df, registry.ORACLE_SQL[name], oracle.connect(one_name)) == ""
    df.collect()
    assert most_rows(df) < 40_000


def test_a_link_to_a_removed_note_that_is_not_there_is_cut(spark, sf_dir, tmp_path):
    """The last note, n29, links to n30, which every tenth is, and which isn't among the notes."""
    from corpuslens.plans import more  # noqa: F401

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.where("p_partkey < 30").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["removed_notes"](spark, str(tmp_path))
    assert oracle.differences(got, registry.ORACLE_SQL["removed_notes"], oracle.connect(str(tmp_path))) == ""
    assert got.where("note_id = 'n29'").first().text.startswith("twice n30")


def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    """Roles that hold a dash, or none at all, are told apart in what was refused."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = talk.limit(3).withColumn("text", F.lit(" ")).withColumn("role", F.when(F.col("turn") == 0, "a-b"))
    talk.unionByName(odd.withColumn("conv_id", F.col("conv_id") + 1_000_000)).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    con = oracle.connect(str(tmp_path))
    for name in ("gate_stream", "digest_daily", "dedup_captures"):
        assert oracle.differences(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLE_SQL[name], con) == ""
