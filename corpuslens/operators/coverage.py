"""Which tests cover a file, by three signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..tables import shuffled


def coverage_name(f: DataFrame) -> DataFrame:
    """Tests and code with the same stem, wherever they lie."""
    stems = f.withColumn("stem", C.test_stem("path"))
    tests = stems.where("is_test").select("repo_id", "stem", F.col("path").alias("test"))
    return stems.where("category = 'code' and not is_test").join(shuffled(tests), ["repo_id", "stem"]).select("repo_id", "path", "test")


def name_classes(f: DataFrame, stem: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Code (repo_id, stem, path) and tests (repo_id, stem, test): each test of a stem covers each code file of it.

    The pairs of ``coverage_name`` by classes: their rows grow with the files, pairs with the square of a stem's.
    """
    stems = f.withColumn("stem", C.test_stem("path") if stem is None else stem)
    code = stems.where("category = 'code' and not is_test").select("repo_id", "stem", "path").distinct()
    return code, stems.where("is_test").select("repo_id", "stem", F.col("path").alias("test")).distinct()


def covered(code: DataFrame, tests: DataFrame) -> DataFrame:
    """The code files of ``name_classes`` that any test covers."""
    return code.join(tests.select("repo_id", "stem").distinct(), ["repo_id", "stem"], "left_semi")


def test_counts(code: DataFrame, tests: DataFrame) -> DataFrame:
    """repo_id, path, tests: how many tests cover each code file of ``name_classes`` that any does; a stem's are counted once."""
    counts = tests.groupBy("repo_id", "stem").agg(F.count(F.lit(1)).alias("tests"))
    return code.join(counts, ["repo_id", "stem"]).select("repo_id", "path", "tests")


def coverage_import(f: DataFrame, e: DataFrame) -> DataFrame:
    tests = f.where("is_test").select("repo_id", F.col("path").alias("src"))
    return e.join(shuffled(tests), ["repo_id", "src"], "left_semi").select("repo_id", F.col("dst").alias("path"), F.col("src").alias("test"))


#: What may stand around the name of a file in a test.
QUOTES = ('"', "'", "`")


def string_literals(test_text: DataFrame) -> DataFrame:
    """repo_id, test, literal: what lies between two quotes of a kind that follow each other.

    A quote may close one literal and open the next, so a lone one before it costs nothing. Only what
    may be the name of a file is kept: one line without a slash.
    """
    inner = lambda pieces: F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    pieces = F.concat(*[C.let(F.split(F.coalesce("text", F.lit("")), q, -1), inner) for q in QUOTES])
    names = F.filter(F.array_distinct(pieces), lambda x: (x != "") & ~x.rlike(r"[/\n]"))
    return test_text.select("repo_id", F.col("path").alias("test"), F.explode(names).alias("literal"))


def coverage_mention(f: DataFrame, test_text: DataFrame) -> DataFrame:
    """Tests whose text has a code file's name in quotes; of files with one name, the last path is credited.

    A name that holds a quote itself may span several literals, so the few such names are looked for in
    the texts of their repository.
    """
    named = f.where("category = 'code' and not is_test").groupBy("repo_id", C.basename("path").alias("literal")).agg(F.max("path").alias("path"))
    odd = F.col("literal").rlike("[\"'`]")
    plain = string_literals(test_text).join(shuffled(named.where(~odd)), ["repo_id", "literal"]).select("repo_id", "path", "test")
    quoted = lambda q: F.contains(F.col("text"), F.concat(F.lit(q), F.col("literal"), F.lit(q)))
    texts = test_text.select("repo_id", F.col("path").alias("test"), "text")
    return plain.unionByName(texts.join(named.where(odd), "repo_id").where(quoted('"') | quoted("'") | quoted("`")).select("repo_id", "path", "test"))


def union_signals(*signals: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, signals).distinct()


def coverage(*signals: DataFrame) -> DataFrame:
    """repo_id, path, tests: the covering tests, sorted."""
    return union_signals(*signals).groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("test")).alias("tests"))


def untested_areas(f: DataFrame, cov: DataFrame, least: int = 3) -> DataFrame:
    """Directories with several untested code files; severity by how often those changed."""
    code = f.where("category = 'code' and not is_test").withColumn("dir", F.when(C.dir_of("path") == "", ".").otherwise(C.dir_of("path")))
    marked = code.join(shuffled(cov.select("repo_id", "path").withColumn("is_covered", F.lit(True))), ["repo_id", "path"], "left").withColumn("open", F.col("is_covered").isNull())
    areas = marked.groupBy("repo_id", "dir").agg(
        F.count(F.lit(1)).alias("code"),
        F.count_if("open").alias("untested"),
        F.coalesce(F.sum(F.when(F.col("open"), F.col("commits"))), F.lit(0)).alias("commits"),
    )
    rank = F.row_number().over(Window.partitionBy("repo_id", "dir").orderBy("path"))  # four of a group leave each task
    first = marked.where("open").select("repo_id", "dir", "path").withColumn("rank", rank).where(F.col("rank") <= 4)
    named = first.groupBy("repo_id", "dir").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("examples"))
    areas = areas.join(named, ["repo_id", "dir"], "left")
    return areas.where(F.col("untested") >= least)


def untested_finding(areas: DataFrame) -> DataFrame:
    """One finding for each repository, by its most changed untested area."""
    top = areas.groupBy("repo_id").agg(F.max("commits").alias("commits"), F.count(F.lit(1)).alias("areas"), F.sum("untested").alias("untested"))
    return top.select("repo_id", "areas", "untested", F.when(F.col("commits") > 5, "high").otherwise("medium").alias("severity"))
