"""Whole jobs over small repositories."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpuslens import tables
from corpuslens.plans import jobs
from corpuslens.sources import sinks
from corpuslens.streaming import jobs as streams

TEXTS = {
    "AGENTS.md": "# rules\nsee `lib/core.js` and `lib/gone.js`\n",
    "CONTEXT.md": "## Core\n",
    "lib/core.js": "export const x = 1;\n",
    "lib/api.js": "import { x } from './core.js';\n",
    "lib/lone.js": "const y = 1;\n",
    "lib/ui.tsx": "import './api.js';\n",
    "lib/big.js": "x;\n" * 700,
    "test/core.test.js": "import '../lib/core.js';\nrun('api.js');\n",
    "node_modules/z.js": "",
    ".corpuslens/memory/2024-01-01.md": "",
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([("r", p, t) for p, t in TEXTS.items()], "repo_id string, path string, text string")


@pytest.fixture(scope="module")
def index(spark, corpus):
    touches = spark.createDataFrame([("r", "lib/lone.js")] * 7 + [("r", "lib/core.js")], "repo_id string, path string")
    return jobs.build_index(corpus, touches)


def test_index(index, spark, tmp_path):
    f = {r.path: r for r in index["files"].collect()}
    assert set(f) == set(TEXTS) - {"node_modules/z.js", ".corpuslens/memory/2024-01-01.md"}
    assert {p: (r.depth, r.inbound, r.commits) for p, r in f.items() if p.startswith("lib/")} == {"lib/core.js": (0, 2, 1), "lib/api.js": (1, 1, 0), "lib/lone.js": (0, 0, 7), "lib/ui.tsx": (2, 0, 0), "lib/big.js": (0, 0, 0)}
    assert f["AGENTS.md"].depth is None and f["test/core.test.js"].is_test
    assert {(r.depth, r.files) for r in index["layers"].collect()} == {(0, 3), (1, 2), (2, 1)}
    assert {(r.area, r.files) for r in index["areas"].collect()} == {("root", 2), ("lib", 5), ("test", 1)}
    sinks.write_index({k: index[k] for k in ("files", "edges")}, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i/edges")).count() == index["edges"].count() == 3


def test_index_lists_the_paths_of_each_layer(index):
    listed = sorted((r.depth, r.place, r.path) for r in index["layers"].collect())
    assert listed == [(0, 1, "lib/big.js"), (0, 2, "lib/core.js"), (0, 3, "lib/lone.js"), (1, 1, "lib/api.js"), (1, 2, "test/core.test.js"), (2, 1, "lib/ui.tsx")]


def test_findings_and_report(index, corpus, spark):
    repos = spark.createDataFrame([("r",), ("empty",)], "repo_id string")
    found = jobs.analyse(index, corpus, corpus, repos)
    got = {(r.repo_id, r.seq): r for r in found.collect()}
    assert {k for k in got} == {("empty", 0), *[("r", k) for k in (4, 8, 10, 11, 12, 15, 16)]}
    assert got["r", 8].severity == "high" and got["r", 8].title.startswith("3 modules") and got["r", 8].evidence == ["lib - 3 of 5 untested, 7 recent commits: lib/big.js, lib/lone.js, lib/ui.tsx"]
    assert got["r", 10].evidence == ["lib/big.js", "lib/lone.js"] and got["r", 12].evidence[0] == "lib/lone.js - 7 commits"
    assert got["r", 15].targets == ["browser"] and got["r", 16].targets == ["lib"] and got["r", 11].evidence == ["lib/big.js - 701 lines"]
    assert [k for _, k in sorted((r.rank, r.seq) for (repo, _), r in got.items() if repo == "r")] == [8, 16, 11, 4, 10, 12, 15]
    text = {r.repo_id: r.report_md for r in jobs.report(index, found, repos, "2024-01-02").collect()}
    assert "- 8 files" in text["r"] and "- 3 resolved imports" in text["r"] and "javascript 5" in text["r"] and "Nothing to index yet" in text["empty"]


def test_secrets_come_first(spark):
    secret = "tok" + 'en = "' + "Zx9" * 5 + '"'
    ft = spark.createDataFrame([("r", "a.py", secret), ("r", "tests/b.py", secret)], "repo_id string, path string, text string")
    found = jobs.analyse(jobs.build_index(ft), ft, ft).where("rank = 1").first()
    assert (found.severity, found.title, found.targets, found.evidence) == ("critical", "Possible secrets in 1 file", ["a.py", "tests/b.py"], ["a.py: assigned secret", "tests/b.py: assigned secret"])


def test_review_and_impact(index, corpus, spark):
    changed = spark.createDataFrame([("r", "./lib\\core.js"), ("r", "lib/typo.js")], "repo_id string, path string")
    got = jobs.review_change(index, corpus, changed)
    assert [r.path for r in got["known"].collect()] == ["lib/core.js"] and [r.path for r in got["unknown"].collect()] == ["lib/typo.js"]
    assert [(r.doc, r.covers) for r in got["briefs"].collect()] == [("AGENTS.md", ["lib/core.js"])]
    assert [r.term for r in got["glossary"].collect()] == ["Core"] and got["decisions"].count() == 0
    assert [(r.doc, r.line, r.names) for r in got["stale"].collect()] == [("AGENTS.md", 2, "lib/core.js")]
    out = jobs.impact_report(index, corpus, changed.withColumn("query_id", F.lit("q")))
    assert [(r.path, r.hops, r.covered) for r in out["affected"].orderBy("hops", "path").collect()] == [("lib/api.js", 1, True), ("test/core.test.js", 1, False), ("lib/ui.tsx", 2, False)]
    assert [r.path for r in out["unverified"].collect()] == ["lib/ui.tsx"] and [r.test for r in out["tests"].collect()] == ["test/core.test.js"]
    assert [r.path for r in out["unknown"].collect()] == ["lib/typo.js"]


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    """What came before a restart isn't read again, and a batch that is written twice stays one."""
    schema = "entry_id string, repo_id string, ts timestamp, kind string, body string"
    put = lambda k: spark.createDataFrame([(f"{k}{i}", "r", None, "note", "fine" if i else "tok" + 'en = "' + "Zx9" * 5 + '"') for i in range(3)], schema).withColumn("ts", F.lit("2024-01-02").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: streams.stream_gate(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "m"), str(tmp_path / "q"), str(tmp_path / "c")).awaitTermination()
    read = lambda x: sorted(r.entry_id for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / x)).collect())
    put("a")
    run()
    put("b")
    run()
    run()
    assert read("m") == ["a1", "a2", "b1", "b2"] and read("q") == ["a0", "b0"]


def feed(spark, folder, *rows):
    frame = spark.createDataFrame([("r", p, datetime.datetime(2024, m, d) if m else None) for p, m, d in rows], "repo_id string, path string, ts timestamp")
    frame.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(frame.schema).parquet(str(folder))


def test_running_counts_expire_and_change_their_buckets_only(spark, tmp_path):
    out = str(tmp_path / "out")

    def hot(*rows):
        days = streams.stream_hotspots(feed(spark, tmp_path / "in", *rows))
        streams.keep_hotspots(days, out, str(tmp_path / "state"), buckets=16).awaitTermination()
        return {r.path: r.touches for r in streams.read_hotspots(spark, out).collect()}

    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert hot(("a", 1, 5), ("a", 1, 5), ("b", 2, 1), ("c", 2, 1)) == {"a": 2, "b": 1, "c": 1}
    before = files()
    assert hot(("a", 1, 5), ("a", 3, 1)) == {"a": 4, "b": 1, "c": 1}
    assert len(files()) == len(before) + 1 and before.items() <= files().items()  # a's bucket anew, the others as they were
    assert hot(("b", 4, 20)) == {"a": 1, "b": 2, "c": 1}  # January is over
    assert hot(("a", 1, 6), ("c", 4, 20)) == {"a": 1, "b": 2, "c": 2}  # a late touch that no window holds
    # the last batch runs again: its commit is lost, its output and all before it are there
    newest = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    days = streams.stream_hotspots(spark.readStream.schema("repo_id string, path string, ts timestamp").parquet(str(tmp_path / "in")))
    streams.keep_hotspots(days, out, str(tmp_path / "state"), buckets=16).awaitTermination()
    assert {r.path: r.touches for r in streams.read_hotspots(spark, out).collect()} == {"a": 1, "b": 2, "c": 2}


def test_late_rows_are_behind_the_watermark_of_earlier_batches(spark, tmp_path):
    def split(*rows):
        src = feed(spark, tmp_path / "in", *rows) if rows else spark.readStream.schema("repo_id string, path string, ts timestamp").parquet(str(tmp_path / "in"))
        streams.stream_late_split(src, *(str(tmp_path / x) for x in ("day", "late", "state"))).awaitTermination()
        read = lambda x: sorted(r.path for r in spark.read.schema("path string").option("recursiveFileLookup", True).parquet(str(tmp_path / x)).collect())
        return read("day"), read("late")

    assert split(("a", 1, 10), ("b", 1, 2), ("none", 0, 0)) == (["a", "b"], ["none"])  # out of order, but in one batch
    assert split(("c", 1, 8), ("d", 1, 7), ("e", 1, 20)) == (["a", "b", "c", "e"], ["d", "none"])
    assert split(("f", 1, 17), ("g", 1, 5)) == (["a", "b", "c", "e"], ["d", "f", "g", "none"])
    want = split(("h", 1, 19))
    assert want == (["a", "b", "c", "e", "h"], ["d", "f", "g", "none"])
    newest = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    assert split() == want  # the batch that runs again decides alike
    assert [p.name for p in sorted((tmp_path / "day").rglob("day=2024-01-19"))] == ["day=2024-01-19"]


def test_tables_of_an_application_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    held = tables.settle(spark.range(3), "some")
    assert held.count() == 3 and any(tmp_path.rglob("*.parquet"))
    tables.clear_tables(spark)
    assert not any(tmp_path.rglob("*.parquet"))


def test_a_cluster_must_name_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "a"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Session())
