"""Plans and rounds that must not grow with the input, whatever the size of the files says."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import coverage, graph, imports
from corpuslens.sources import scans
from corpuslens.tables import settle


def plan(df) -> str:
    """The physical plan, as it is before anything runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def joins_of(df, *keys: str) -> set[str]:
    """Kinds of the joins whose keys hold these columns."""
    found = [x for x in plan(df).splitlines() if "Join" in x and all(k in x for k in keys)]
    return {w for x in found for w in x.replace("(", " ").split() if w.endswith("Join")}


def exchanged(df) -> int:
    """The most rows that any shuffle of a frame wrote, which was run before."""
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.fixture(scope="module")
def module_files(spark):
    """3,000 modules, each of which imports the next one, in a file of a few kilobytes."""
    k = F.col("id")
    text = F.concat(F.lit("import m.p"), (k + 1).cast("string"), F.lit("\n"))
    return settle(spark.range(3000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("m/p"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("text"), F.lit(1).alias("lines"), F.lit(1).alias("bytes")), "module-files")


def test_files_are_not_broadcast_to_imports(module_files):
    f, specs = settle(scans.describe_files(module_files), "f"), settle(imports.extract_imports(module_files), "s")
    resolved = imports.resolve_imports(specs, f)
    assert joins_of(resolved, "candidate") == {"SortMergeJoin"}
    edges = imports.build_edges(settle(resolved, "resolved"), f)
    assert joins_of(edges, "path") == {"SortMergeJoin"} and edges.count() == 2999
    assert "Join" not in plan(imports.extract_imports(module_files))  # twins are told apart in their row


def test_what_many_files_import_is_looked_up_once(spark):
    """300 files in three directories import the same 20 modules: 6,000 specifiers, of three candidates each, are 60 distinct ones."""
    k, j = F.col("id"), F.sequence(F.lit(0), F.lit(19))
    here = F.concat(F.lit("d"), (k % 3).cast("string"), F.lit("/"))
    said = F.concat(F.array_join(F.transform(j, lambda i: F.concat(F.lit("import m.p"), i.cast("string"))), "\n"), F.lit("\nfrom .m.p0 import x\n"))
    texts = spark.range(300).select(F.lit("r").alias("repo_id"), F.concat(here, k.cast("string"), F.lit(".py")).alias("path"), said.alias("text"))
    own = spark.range(60).select(F.lit("r"), F.concat(F.when(k < 20, "").when(k < 40, "d1/").otherwise("d2/"), F.lit("m/p"), (k % 20).cast("string"), F.lit(".py")), F.lit(""))
    texts = settle(texts.union(own), "texts")
    f = settle(scans.describe_files(texts.withColumns({"lines": F.lit(1), "bytes": F.lit(1)})), "f")
    specs = imports.extract_imports(texts)
    assert "size(" not in plan(specs)  # texts are searched once
    edges = imports.build_edges(imports.resolve_imports(settle(specs, "s"), f), f)
    want = {(f"d{k % 3}/{k}.py", f"m/p{i}.py") for k in range(300) for i in range(20)}
    want |= {(f"d{k % 3}/{k}.py", f"d{k % 3}/m/p0.py") for k in range(300) if k % 3}
    assert [tuple(sorted(want))] == [tuple(sorted((r.src, r.dst) for r in edges.collect()))]
    assert exchanged(edges) <= 6300  # its specifiers, not their candidates


def test_files_are_not_broadcast_in_the_index(module_files):
    f = settle(scans.describe_files(module_files), "f")
    e = settle(f.select("repo_id", F.col("path").alias("src"), F.col("path").alias("dst")), "e")
    for df in (graph.with_inbound(f, e), graph.orphans(f, e), coverage.coverage_import(f.withColumn("is_test", F.col("path").endswith("1.py")), e), coverage.coverage_name(f)):
        assert joins_of(df) == {"SortMergeJoin"}


def test_search_shuffles_notes_and_their_best_only(spark):
    """200 notes of 300 words each: their words and scores stay where the notes are."""
    from corpuslens.operators import notes

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("a"), (i + F.col("id") * 300).cast("string"))), " ")
    n = settle(spark.range(200).select(F.col("id").alias("path"), words.alias("text"), F.col("id").alias("mtime")), "notes")
    q = spark.createDataFrame([(1, "a"), (2, "a1 1 zz")], "query_id int, query string")
    got = notes.recall_many(n, q)
    rows = got.collect()
    assert [(r.path, r.score) for r in rows if r.query_id == 1] == [(p, 300) for p in range(199, 191, -1)]
    assert exchanged(got) <= 200 + 2 * 8 * 8


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that a graph operator writes."""
    rows = []

    def count(df, name):
        out = settle(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "settle", count)
    return rows


def test_rounds_of_depth_do_not_rewrite_edges(spark, written):
    """Each of 30 nodes on all before it: 435 edges, of which a round takes some."""
    e = spark.createDataFrame([("r", a, b) for a in range(30) for b in range(a)], "repo_id string, src long, dst long")
    assert {(r.node, r.depth) for r in graph.depth(e).collect()} == {(k, k) for k in range(30)}
    assert sum(written) < 2000


def test_components_do_not_rewrite_edges(spark, written):
    e = spark.createDataFrame([("r", a, b) for a in range(30) for b in range(30) if a != b], "repo_id string, src long, dst long")
    assert {(r.node, r.scc, r.is_cyclic) for r in graph.scc(e).collect()} == {(k, 29, True) for k in range(30)}
    assert sum(written) < 2 * 870


def test_tables_are_dealt_by_their_rows(spark, monkeypatch):
    """A task's share stays as it is: the number of tasks follows the rows, not the session."""
    from corpuslens.operators import enrichment

    for module in (enrichment, graph):
        monkeypatch.setattr(module, "tasks_for", lambda *_: 7)
    b = settle(spark.range(100).select(F.lit("r").alias("repo_id"), (F.col("id") % 9).alias("batch_index"), F.col("id").alias("path"), F.lit(2).alias("lines")), "b")
    stats = enrichment.batch_stats(b, b)
    assert ", 7)" in plan(stats) and [(r.batches, r.files, r.most_lines) for r in stats.collect()] == [(9, 100, 24)]
    e = b.select("repo_id", F.col("path").alias("src"), (F.col("path") + 1).alias("dst"))
    assert plan(graph.batch_neighbours(b, e)).count(", 7)") >= 4


def test_a_layer_is_listed_by_many_tasks(spark, monkeypatch):
    """Each of 300 files imports the one of half its number, in two repositories; seven tasks place them."""
    monkeypatch.setattr(graph, "tasks_for", lambda *_: 7)
    f = spark.createDataFrame([(r, str(i)) for r in "ab" for i in range(1, 301)], "repo_id string, path string")
    e = f.where("path != '1'").select("repo_id", F.col("path").alias("src"), F.floor(F.col("path").cast("int") / 2).cast("string").alias("dst"))
    got = graph.layers(settle(graph.leveled(f, e), "leveled"))
    names = [sorted(str(i) for i in range(2**d, min(2 ** (d + 1), 301))) for d in range(9)]
    want = {(r, d, len(x), k, p) for r in "ab" for d, x in enumerate(names) for k, p in enumerate(x, 1)}
    assert {tuple(r)[:5] for r in got.collect()} == want and got.count() == 600


def test_paths_of_a_directory_do_not_meet_in_one_task(spark):
    from corpuslens.operators import review

    f = settle(spark.range(500).select(F.lit("r").alias("repo_id"), F.concat(F.lit("src/a/p"), F.col("id").cast("string")).alias("path")), "f")
    docs = spark.createDataFrame([("r", "AGENTS.md", "x\ny"), ("r", "src/AGENTS.md", "x\ny")], "repo_id string, path string, text string")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = review.governing_docs(f, docs)
        assert joins_of(found, "dir") == {"BroadcastHashJoin"} and found.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
