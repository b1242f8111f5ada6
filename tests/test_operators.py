"""Behaviours of the operators on small inline tables."""

import datetime
import random
from collections import Counter
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import columns as C
from corpuslens.functions import tables
from corpuslens.operators import coverage, duplicates, enrichment, files, findings, graph, imports, notes, review, secrets, stack
from corpuslens.sources import scans, sinks


def edges(spark, *pairs):
    return spark.createDataFrame([("r", *p.split(">")) for p in pairs], "repo_id string, src string, dst string")


def seeds(spark, *paths):
    return spark.createDataFrame([("q", "r", p) for p in paths], "query_id string, repo_id string, path string")


def file_text(spark, **texts):
    return spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo_id string, path string, text string")


def described(ft):
    return scans.describe_files(ft.withColumn("lines", C.line_count("text")).withColumn("bytes", F.octet_length("text")))


# graphs


def test_impact_counts_fewest_hops_and_ends_on_cycles(spark):
    found, cut = graph.impact(edges(spark, "b>a", "c>b", "c>a", "a>c"), seeds(spark, "a"))
    assert {(r.path, r.hops) for r in found.collect()} == {("b", 1), ("c", 1)} and not cut.first().truncated
    found, cut = graph.impact(edges(spark, "b>a", "c>b", "d>c"), seeds(spark, "a"), 2)
    assert {(r.path, r.hops) for r in found.collect()} == {("b", 1), ("c", 2)} and cut.first().truncated


def test_each_search_has_its_own_limit(spark):
    rng = random.Random(4)
    links = {(rng.randrange(60), rng.randrange(60)) for _ in range(110)}
    e = spark.createDataFrame([("r", str(a), str(b)) for a, b in links], "repo_id string, src string, dst string")
    starts = {q: (rng.sample(range(60), 2), rng.choice([None, 0, 1, 2, 3, 5])) for q in range(25)}
    s = spark.createDataFrame([(q, "r", str(p), most) for q, (paths, most) in starts.items() for p in paths], "query_id int, repo_id string, path string, max_depth int")
    found, searches = graph.impact(e, s)
    want, cut = set(), {}
    for q, (paths, most) in starts.items():
        hops = dict.fromkeys(paths, 0)
        queue = list(paths)
        for p in queue:
            for a, b in links:
                if b == p and a not in hops:
                    hops[a] = hops[p] + 1
                    queue.append(a)
        want |= {(q, str(p), n) for p, n in hops.items() if n and (most is None or n <= most)}
        cut[q] = most is not None and max(hops.values()) > most
    assert {(r.query_id, r.path, r.hops) for r in found.collect()} == want
    assert {r.query_id: r.truncated for r in searches.collect()} == cut and {True, False} == set(cut.values())


def test_depth_and_cycles(spark):
    d = {r.node: (r.depth, r.is_cyclic) for r in graph.depth(edges(spark, "b>a", "c>a", "c>b")).collect()}
    assert d == {"a": (0, False), "b": (1, False), "c": (2, False)}
    d = {r.node: (r.depth, r.is_cyclic) for r in graph.depth(edges(spark, "a>b", "b>a", "top>a", "a>a")).collect()}
    assert d == {"a": (0, True), "b": (0, True), "top": (1, False)}


def test_layers_list_every_file(spark):
    """Two files in a circle, one above it, one that stands alone, an edge to itself and one to what is no file."""
    f = spark.createDataFrame([("r", p) for p in ("top", "b", "a", "lone", "base", "lone")] + [("s", "a")], "repo_id string, path string")
    e = edges(spark, "a>b", "b>a", "a>base", "top>b", "top>top", "lone>gone", "gone>top")
    got = sorted(tuple(r) for r in graph.layers(graph.leveled(f, e)).select("repo_id", "depth", "files", "place", "path", "is_cyclic").collect())
    assert got == [("r", 0, 2, 1, "base", False), ("r", 0, 2, 2, "lone", False), ("r", 1, 2, 1, "a", True), ("r", 1, 2, 2, "b", True), ("r", 2, 1, 1, "top", False), ("s", 0, 1, 1, "a", False)]
    assert graph.layers(graph.leveled(f.limit(0), e)).count() == 0


def test_scc_against_brute_force(spark):
    rng = random.Random(7)
    for _ in range(2):
        pairs = {(rng.randrange(9), rng.randrange(9)) for _ in range(14)}
        pairs = {p for p in pairs if p[0] != p[1]}
        reach = {a: {a} for a in range(9)}
        for _ in range(9):
            for a, b in pairs:
                for k in reach:
                    if a in reach[k]:
                        reach[k].add(b)
        nodes = {x for p in pairs for x in p}
        want = {a: max(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
        got = graph.scc(spark.createDataFrame([("r", a, b) for a, b in pairs], "repo_id string, src long, dst long"))
        assert {r.node: r.scc for r in got.collect()} == want


def test_renames_follow_chains_and_stop_on_cycles(spark):
    log = spark.createDataFrame([("r", i, f"f{i}", f"f{i + 1}") for i in range(7)] + [("c", 1, "a", "b"), ("c", 2, "b", "a"), ("c", 3, "t", "u"), ("c", 4, "u", "b"), ("r", 9, "f0", "old")], "repo_id string, seq long, old_path string, new_path string")
    got = {(r.repo_id, r.old_path): r.final_path for r in graph.follow_renames(log).collect()}
    assert got == {("r", f"f{i}"): "f7" for i in range(7)} | {("c", "t"): "b", ("c", "u"): "b"}


def test_orphans_and_inbound(spark):
    f = spark.createDataFrame([("r", p, "python", "code", False, e) for p, e in (("a", False), ("b", False), ("c", False), ("m", True))], "repo_id string, path string, lang string, category string, is_test boolean, is_entry boolean")
    e = edges(spark, "a>b")
    assert [r.path for r in graph.orphans(f, e).collect()] == ["c"]
    assert {r.path: r.inbound for r in graph.with_inbound(f, e).collect()} == {"a": 0, "b": 1, "c": 0, "m": 0}


# files


def test_skips_and_guesses(spark):
    f = spark.createDataFrame([("r", p) for p in ("bin/run.sh", "obj/x.cs", "node_modules/a.js", "a.png", "yarn.lock", "src/a.js", "bin/b.png")], "repo_id string, path string")
    tracked = spark.createDataFrame([("r", "bin/run.sh")], "repo_id string, path string")
    assert {r.path for r in files.skip_ambiguous(files.skip_paths(f), tracked).collect()} == {"bin/run.sh", "src/a.js"}
    assert {(r.dir, r.files) for r in files.skipped_by_guess(f, tracked).collect()} == {("obj", 1)}


def test_ignore_patterns(spark):
    n = spark.createDataFrame([(v, p) for v in ("has", "none") for p in ("a.md", "archives/x.md", "d/tmp/y.md", "README.md", "p.bak", "node_modules/z.md")], "vault_id string, path string")
    patterns = spark.createDataFrame([("has", "tmp/"), ("has", "*.bak"), ("has", "# no"), ("has", "")], "vault_id string, pattern string")
    got = {(r.vault_id, r.path) for r in files.apply_ignore(n, patterns).collect()}
    assert got == {("has", "a.md"), ("has", "archives/x.md"), ("has", "README.md"), ("none", "a.md"), ("none", "d/tmp/y.md"), ("none", "p.bak")}


def test_missing_context(spark):
    f = spark.createDataFrame([("r", "CLAUDE.md"), ("r", "docs/adr/1.md"), *[("big", f"src/{i}.py") for i in range(50)], ("told", "a.py")], "repo_id string, path string")
    present = f.unionByName(spark.createDataFrame([("told", ".corpuslens/memory/2024-01-01.md"), ("big", ".corpuslens/index/x")], "repo_id string, path string"))
    got = {}
    for r in files.missing_context(f, present).collect():
        got.setdefault(r.repo_id, set()).add(r.kind.removeprefix("missing-"))
    assert got == {"r": {"glossary", "memory"}, "big": {"brief", "glossary", "decisions", "memory", "enriched"}, "told": {"brief", "glossary", "decisions"}}


def test_scan_corpus(spark, tmp_path):
    (tmp_path / "one/src").mkdir(parents=True)
    (tmp_path / "one/src/a.py").write_text("x\ny\n")
    (tmp_path / "one/b.bin").write_bytes(b"\x00\x01")
    got = scans.scan_corpus(spark, str(tmp_path)).collect()
    assert [(r.repo_id, r.path, r.bytes, r.lines, r.text) for r in got] == [("one", "src/a.py", 4, 3, "x\ny\n")]


def test_logs(spark, tmp_path):
    (tmp_path / "r.log").write_text("@abc 86400\n\na.py\nb.py\n@def 172800\n\na.py\n")
    (tmp_path / "r.renames").write_text("R100\tb\tc\nM\tx\nR090\ta\tb\n")
    touches = scans.read_touches(spark, str(tmp_path / "r.log"))
    assert {(r.sha, r.path) for r in touches.collect()} == {("abc", "a.py"), ("abc", "b.py"), ("def", "a.py")}
    assert [(r.old_path, r.new_path) for r in scans.read_renames(spark, str(tmp_path / "r.renames")).orderBy("seq").collect()] == [("b", "c"), ("a", "b")]


# imports

CASES = [
    ("js", {"src/a.ts": "import x from './b';\nimport y from '../lib';\nimport './c.js';\nimport z from 'react';", "src/b.ts": "", "lib/index.ts": "", "src/c.ts": ""}, {("src/a.ts", "src/b.ts"), ("src/a.ts", "lib/index.ts"), ("src/a.ts", "src/c.ts")}),
    ("python", {"pkg/a.py": "from .b import x\nfrom . import c\nimport pkg.d\nimport os", "pkg/b.py": "", "pkg/d/__init__.py": "", "pkg/__init__.py": ""}, {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/d/__init__.py"), ("pkg/a.py", "pkg/__init__.py")}),
    ("go", {"go.mod": "module ex.com/y\n", "main.go": 'import (\n  "fmt"\n  "ex.com/y/z"\n  "ex.com/y-extra/q"\n)', "z/one.go": "", "z/two.go": "", "z/two_test.go": ""}, {("main.go", "z/one.go"), ("main.go", "z/two.go")}),
    ("rust", {"src/lib.rs": "mod util;\npub mod net;", "src/util.rs": "use crate::net::tcp::Conn;", "src/net/mod.rs": "", "tests/cli.rs": "mod helper;", "tests/helper.rs": ""}, {("src/lib.rs", "src/util.rs"), ("src/lib.rs", "src/net/mod.rs"), ("src/util.rs", "src/net/mod.rs"), ("tests/cli.rs", "tests/helper.rs")}),
    ("java", {"src/main/java/a/B.java": "import a.C;\nimport static a.D.go;\nimport java.util.List;", "src/main/java/a/C.java": "", "src/main/java/a/D.java": ""}, {("src/main/java/a/B.java", "src/main/java/a/C.java"), ("src/main/java/a/B.java", "src/main/java/a/D.java")}),
    ("php", {"composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/"}}}', "src/A.php": "use App\\Sub\\B;\nuse Other\\X;", "src/Sub/B.php": ""}, {("src/A.php", "src/Sub/B.php")}),
    ("ruby", {"lib/a.rb": "require_relative 'b'\nrequire 'c/d'", "lib/b.rb": "", "lib/c/d.rb": ""}, {("lib/a.rb", "lib/b.rb"), ("lib/a.rb", "lib/c/d.rb")}),
    ("shell", {"bin/a.sh": '. "$ROOT/lib/x.sh"\nsource ./y.sh', "lib/x.sh": "", "bin/y.sh": ""}, {("bin/a.sh", "lib/x.sh"), ("bin/a.sh", "bin/y.sh")}),
]


@pytest.mark.parametrize(("name", "texts", "want"), CASES, ids=[c[0] for c in CASES])
def test_imports(spark, name, texts, want):
    ft = file_text(spark, **texts)
    f = described(ft)
    resolved = imports.resolve_imports(imports.extract_imports(ft), f, scans.read_manifests(ft))
    assert {(r.src, r.dst) for r in imports.build_edges(resolved, f).collect()} == want


def test_external_packages(spark):
    ft = file_text(spark, **{"a.js": "import fs from 'fs'; import x from '@s/p/deep'; import y from 'left-pad';", "a.test.js": "import z from 'jest';"})
    specs = imports.extract_imports(ft)
    builtins = spark.createDataFrame([("fs",)], "package string")
    assert {r.package for r in imports.external_packages(specs, builtins).collect()} == {"@s/p", "left-pad"}


# coverage, findings


def test_coverage_signals(spark):
    ft = file_text(spark, **{"lib/x.js": "", "test/x.test.js": "", "lib/y.js": "", "test/other.test.js": "run('y.js') // z.js", "lib/z.js": ""})
    f = described(ft)
    cov = {r.path: r.tests for r in coverage.coverage(coverage.coverage_name(f), coverage.coverage_mention(f, ft.where(C.is_test_path("path")))).collect()}
    assert cov == {"lib/x.js": ["test/x.test.js"], "lib/y.js": ["test/other.test.js"]}


def test_names_in_quotes_cover_wherever_the_quotes_stand(spark):
    texts = {"a = '\"'; run(\"b.js\")": True, 'run("dir/b.js")': False, 'run("b.js")': True, "`x`b.js`": True, "'b.js\"": False, "b.js": False, '"it\'s.js"': False, '"b.js': False}
    for text, is_said in texts.items():
        ft = file_text(spark, **{"lib/b.js": "", "old/b.js": "", "lib/it's.js": "", "test/t.js": text})
        got = [(r.path, r.test) for r in coverage.coverage_mention(described(ft), ft.where(C.is_test_path("path"))).where("path not like '%it_s%'").collect()]
        assert got == ([("old/b.js", "test/t.js")] if is_said else []), text
    ft = file_text(spark, **{"lib/it's.js": "", "test/t.js": "run(\"it's.js\")", "test/u.js": "run('it's.js')", "test/v.js": "it's.js"})
    assert {r.test for r in coverage.coverage_mention(described(ft), ft.where(C.is_test_path("path"))).collect()} == {"test/t.js", "test/u.js"}


def test_offers_collapse(spark):
    rows = [("r", 1, "low", "k", "fix", "t1", ["b", "a"]), ("r", 2, "high", "k", "fix", "t2", ["a", "c"]), ("r", 3, "low", "k", None, "t3", [])]
    df = spark.createDataFrame(rows, "repo_id string, seq int, severity string, kind string, action string, title string, targets array<string>")
    r = findings.offers(df).collect()
    assert [(x.action, x.severity, x.targets, x.titles) for x in r] == [("fix", "high", ["b", "a", "c"], ["t1", "t2"])]
    stats = spark.createDataFrame([("r", 3, 1234, 1, 0, 2, "python 3"), ("empty", 0, 0, 0, 0, 0, None)], "repo_id string, files long, lines long, edges long, tests long, areas long, top string")
    told = df.withColumn("detail", F.lit("why")).withColumn("evidence", F.col("targets"))
    report = {x.repo_id: x.report_md for x in findings.render_reports(told, stats, "2024-01-02").collect()}
    assert report["r"].index("### High") < report["r"].index("#### t2") < report["r"].index("### Low") and "- 1,234 lines\n" in report["r"] and "- python 3\n" in report["r"]
    assert "why\n\n```\nb\na\n```" in report["r"] and "### Critical" not in report["r"] and report["r"].endswith("which findings to act on.")
    assert "Nothing found." in report["empty"] and "no code yet" in report["empty"]


# secrets; values are put together at run time


def test_secret_rules(spark):
    body = "Ab3" * 12
    hits = {
        "AWS access key id": "AK" + "IA" + "ABCDEFGH12345678",
        "GitHub token": "gh" + "p_" + body[:20],
        "Slack token": "xo" + "xb-" + body[:14],
        "Google API key": "AI" + "za" + body[:35],
        "Stripe key": "sk" + "_live_" + body[:20],
        "connection string with password": "db" + "://me:" + "hunter22@host/x",
        "assigned secret": "tok" + 'en = "' + body[:12] + '"',
        "bearer token": "Bea" + "rer\n" + body[:24],
    }
    docs = spark.createDataFrame([("r", k, "x\nnaïve é" + v + "\n") for k, v in hits.items()], "repo_id string, path string, text string")
    got = secrets.scan_secrets(docs).collect()
    assert {r.path for r in got if r.kind == r.path} == set(hits)
    assert all(r.line == 2 for r in got) and all(r.match_redacted not in hits[r.path] for r in got)


def test_placeholders_are_no_secrets(spark):
    docs = spark.createDataFrame([("r", "a", 'pass' + 'word = "${DB_PASSWORD}" tok' + 'en = "changeme1234" x = "ordinary text"')], "repo_id string, path string, text string")
    assert secrets.scan_secrets(docs).count() == 0


def test_gate_and_memory(spark, tmp_path):
    secret = "tok" + 'en = "' + "Zx9" * 5 + '"'
    rows = [("1", "r", "2024-01-01 10:00:00", "note", "fine"), ("1", "r", "2024-01-01 11:00:00", "note", "fine too"), (None, "r", "2024-01-01 12:00:00", "note", "no id"), ("2", "r", "2024-01-02 10:00:00", "note", secret), (None, "r", "2024-01-02 10:00:00", "note", secret), ("3", "r", "2024-01-02 11:00:00", "note", " \n ")]
    df = spark.createDataFrame(rows, "entry_id string, repo_id string, ts string, kind string, body string").withColumn("ts", F.to_timestamp("ts"))
    for _ in range(2):  # the same batch again replaces itself
        refused = [(r.entry_id, r.kinds) for r in sinks.append_memory(df, str(tmp_path / "m"), "a").collect()]
        assert sorted(refused, key=str) == sorted([("2", ["assigned secret"]), (None, ["assigned secret"]), ("3", ["empty"])], key=str)
    sinks.append_memory(df.limit(1), str(tmp_path / "m"), "b")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4


def test_recent_memory_opens_recent_days_only(spark, tmp_path):
    days = [("a", d) for d in (1, 2, 3, 9, 20)] + [("b/c", d) for d in (1, 2)] + [("007", 5)]
    rows = [(f"{r}{d}{k}", r, datetime.datetime(2024, 1, d, k), "note", f"{d}") for r, d in days for k in (1, 2)]
    df = spark.createDataFrame(rows, "entry_id string, repo_id string, ts timestamp, kind string, body string")
    at = str(tmp_path / "m")
    sinks.append_memory(df.where("day(ts) != 9"), at, "1")
    sinks.append_memory(df.where("day(ts) = 9"), at, "2")
    got = scans.scan_recent_memory(spark, at, 3)
    assert {(r.repo_id, r.day.day) for r in got.collect()} == {("a", 20), ("a", 9), ("a", 3), ("b/c", 2), ("b/c", 1), ("007", 5)} and got.count() == 12
    opened = {unquote(f).split("/m/")[1].rsplit("/", 1)[0] for f in got.inputFiles()}
    assert opened == {"batch=1/repo=a/day=2024-01-20", "batch=2/repo=a/day=2024-01-09", "batch=1/repo=a/day=2024-01-03", "batch=1/repo=b%2Fc/day=2024-01-02", "batch=1/repo=b%2Fc/day=2024-01-01", "batch=1/repo=007/day=2024-01-05"}


def test_secret_findings_count_what_is_real(spark):
    secret = "tok" + 'en = "' + "Zx9" * 5 + '"'
    texts = {("r", "lib/a.py"): secret, ("r", "spec"): secret, ("r", "examples/b.py"): secret + "\n" + secret, ("r", "doc.md"): secret, ("t", "test/x.py"): secret, ("e", "x.py"): secret + " # corpuslens:allow-secrets", ("r", "long.py"): secret + "x" * 400_000}
    ft = spark.createDataFrame([(r, p, t) for (r, p), t in texts.items()], "repo_id string, path string, text string")
    got = {(r.repo_id, r.kind): (r.severity, r.hits, r.files, r.targets) for r in secrets.secret_findings(secrets.leaky_files(ft)).collect()}
    said = {r.repo_id: r.evidence for r in secrets.secret_findings(secrets.leaky_files(ft)).where("kind = 'secrets'").collect()}
    assert said == {"r": ["examples/b.py: assigned secret, assigned secret", "lib/a.py: assigned secret", "spec: assigned secret"], "t": ["test/x.py: assigned secret"]}
    assert got == {("r", "secrets"): ("critical", 1, 1, ["examples/b.py", "lib/a.py", "spec"]), ("t", "secrets"): ("medium", 1, 1, ["test/x.py"]), ("e", "secrets-exempt"): ("low", 1, 1, [])}


def test_firewalled_terms(spark):
    n = spark.createDataFrame([("v", "a.md", "fine\nAcme plans\n"), ("v", "b.md", "none")], "vault_id string, path string, text string")
    assert [(r.path, r.line, r.term) for r in secrets.firewall_hits(n, ["ACME"]).collect()] == [("a.md", 2, "acme")]


# SQL table functions


def test_table_functions_give_what_the_jobs_give(spark):
    tables.register(spark)
    secret = "tok" + 'en = "' + "Zx9" * 5 + '"'
    docs = file_text(spark, **{"a": f"one\n{secret}\n\nit's {secret}", "b": "-----BEGIN PRIVATE " + "KEY-----\n", "c": 'pass' + 'word = "${DB_PASSWORD}"', "d": None, "e": ""})
    got = spark.sql("select path, s.* from {d}, lateral secrets_of(text) as s", d=docs).collect()
    want = secrets.scan_secrets(docs, keys=("path",)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.line for r in got} == {1, 2, 4}
    code = file_text(spark, **{"a.rb": "require_relative 'x'\nrequire 'x'\nrequire 'y'", "b.go": 'import (\n "a"\n z "b/c"\n)', "c.ts": "import x from './y';\nexport * from \"z\"", "Makefile": "import x", "d.py": "from .a import b\nimport c.d"})
    got = spark.sql("select c.path, i.* from {c} as c, lateral imports_of(path, text) as i", c=code).collect()
    want = imports.extract_imports(code).select("path", "spec", "tag", "pos").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 8


# near duplicates


def near_by_hand(texts, percent=75):
    """All links between different sets, and {id: class}, by comparing every pair."""
    sets = {}
    for i, text in texts:
        w = (text or "").lower().split()
        if w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = []
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links += [(a, b)] if sets[a] != sets[b] else []
                x, y = sorted((top(a), top(b)))
                root[y] = x
    classes = {i: top(i) for i in ids}
    several = Counter(classes.values())
    return links, {i: c for i, c in classes.items() if several[c] > 1}


def near_texts():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(900)]
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO"), (4, "x " * 5000)]
    for base in range(40):
        own = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 7)):
            text = list(own)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(text)))
    template = [rng.choice(words) for _ in range(200)]
    for k in range(150):  # a template with another name in each text
        rows.append((len(rows), " ".join([*template[:100], f"name{k}", *template[100:]])))
    return rows


def test_near_duplicates_against_every_pair(spark):
    rows = near_texts()
    links, classes = near_by_hand(rows)
    df = spark.createDataFrame(rows, "path long, text string").repartition(3)
    got = {r.path: r.class_id for r in duplicates.duplicates_near(df).collect()}
    found = sum(got.get(a, -1) == got.get(b, -2) for a, b in links)
    assert len(links) > 11_000 and found >= 0.9 * len(links)
    assert got.items() <= classes.items() or all(classes[i] == classes[c] for i, c in got.items())  # nothing that isn't near
    assert len(got) >= 0.95 * len(classes)
    sets = df.select(F.col("path").alias("node"), duplicates.shingle_hashes("text").alias("hashes")).where("size(hashes) > 0")
    exact = set(links)
    few = {(r.src, r.dst) for r in duplicates.near_links(sets, block=8).collect()}
    assert {(a, b) for a, b in few if a not in (2, 3)} <= exact | {(a, b) for a in classes for b in classes if classes[a] == classes[b]} and len(few) < 8_000
    assert duplicates.duplicates_near(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(140)] + [(700, 700 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for k in sorted(near):
        queue = [] if k in want or near[k] == {k} else [k]
        while queue:
            x = queue.pop()
            if x not in want:
                want[x] = k
                queue += near[x]
    assert got == want
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# documents


def test_governing_docs_and_shims(spark):
    changed = spark.createDataFrame([("r", "a/b/x.py")], "repo_id string, path string")
    docs = file_text(spark, **{"AGENTS.md": "root\nmore", "a/AGENTS.md": "leaf\nmore", "a/b/c/AGENTS.md": "below\nmore", "a/b/CLAUDE.md": "@AGENTS.md", "a/b/gemini.md": "", "CONTEXT.md": "## Term", "docs/adr/1.md": "x"})
    found = review.governing_docs(changed, docs)
    assert [r.doc for r in found.orderBy("nearness").collect()] == ["a/b/gemini.md", "a/AGENTS.md", "AGENTS.md"]
    assert {(r.doc, r.dir, tuple(r.covers)) for r in review.brief_coverage(found).collect()} == {("AGENTS.md", "", ("a/b/x.py",)), ("a/AGENTS.md", "a", ("a/b/x.py",)), ("a/b/gemini.md", "a/b", ("a/b/x.py",))}


def test_needles_are_found_wherever_they_stand(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ab./é\n") for _ in range(n))
    rows = [("r" if k % 3 else "s", k, word(rng.choice([0, 1, 2, 3, 7, 8, 20, 60]))) for k in range(120)]
    needles = [(r, word(n)) for r in "rs" for n in (1, 1, 2, 2, 3, 3, 4, 7, 8, 9, 10)] + [("r", rows[7][2][3:15] or "a"), ("s", "nowhere"), ("t", "a")]
    got = review.holding(spark.createDataFrame(rows, "repo_id string, k int, text string"), "text", spark.createDataFrame(needles * 2, "repo_id string, needle string"))
    want = sorted({(r, k, n) for r, k, t in rows for q, n in needles if q == r and n in t})
    assert sorted((r.repo_id, r.k, r.needle) for r in got.collect()) == want and len(want) > 100


def test_stale_mentions(spark):
    names = ["lib/longname.js", "lib/x.js", "lib/long name.js", "lib/other@2.js", "a/b", "root-file.js", "s.js"]
    changed = spark.createDataFrame([("r", p) for p in names], "repo_id string, path string")
    f = file_text(spark, **dict.fromkeys([*names, "other/x.js", "AGENTS.md", "pkg/docs/adr/1.md", "deep/agents.md"], ""))
    docs = {
        "AGENTS.md": "see lib/longname.js.\nand `longname.js` here\nx.js alone\n  lib/long name.js and lib/other@2.js  \nya/bc\nmyroot-file.jsx",
        "pkg/docs/adr/1.md": "s.js lib/x.js",
        "deep/agents.md": "\n".join(["lib/x.js lib/longname.js"] * 9),
        "notes.md": "lib/longname.js",
        "lib/x.js": "lib/longname.js",
    }
    got = review.stale_mentions(changed, file_text(spark, **docs), f).collect()
    assert sorted((r.line, r.names) for r in got if r.doc == "AGENTS.md") == [(1, "lib/longname.js"), (2, "lib/longname.js"), (4, "lib/long name.js"), (4, "lib/other@2.js"), (5, "a/b"), (6, "root-file.js")]
    assert [r.text for r in got if r.names == "lib/other@2.js"] == ["lib/long name.js and lib/other@2.js"]
    assert [(r.names, r.total) for r in got if r.doc == "pkg/docs/adr/1.md"] == [("lib/x.js", 1)]
    deep = [r for r in got if r.doc == "deep/agents.md"]
    assert len(deep) == 12 and all(r.total == 18 for r in deep) and {r.doc for r in got} == {"AGENTS.md", "pkg/docs/adr/1.md", "deep/agents.md"}


def test_context_documents(spark):
    f = spark.createDataFrame([("r", p) for p in ("agents.md", "pkg/docs/adr/1.md", "docs/adr.md", "a/Context.md", "CLAUDE.mdx")], "repo_id string, path string")
    assert {r.path for r in scans.context_docs(f).collect()} == {"agents.md", "pkg/docs/adr/1.md", "a/Context.md"}


def test_citation_drift_and_patch(spark):
    docs = file_text(
        spark,
        **{
            "docs/AGENTS.md": "see `lib/old.js` and `lib/new.js`\n`lib/gone.js` was removed\n[x](../lib/new.js) [y](https://a.b/c.md) `tools/call`\n`lib/lost.js`",
            "docs/deep/CONTEXT.md": "`../lib/new.js` `../../lib/new.js` `lib/old.js`",
            "docs/adr/1.md": "`lib/old.js`",
            "templates/AGENTS.md": "`lib/lost.js`",
            "pkg/templates/AGENTS.md": "`lib/lost.js`",
            "notes.md": "`lib/lost.js`",
        },
    )
    f = spark.createDataFrame([("r", p) for p in ("lib/new.js", "docs/AGENTS.md", "docs/deep/CONTEXT.md", "docs/adr/1.md", "pkg/templates/AGENTS.md")], "repo_id string, path string")
    renames = spark.createDataFrame([("r", 1, "lib/old.js", "lib/new.js")], "repo_id string, seq long, old_path string, new_path string")
    drift = review.citation_drift(docs, f, renames)
    assert {(r.doc, r.line, r.cited, r["class"], r.suggestion) for r in drift.collect()} == {
        ("docs/AGENTS.md", 1, "lib/old.js", "provable", "lib/new.js"),
        ("docs/AGENTS.md", 2, "lib/gone.js", "historical", None),
        ("docs/AGENTS.md", 4, "lib/lost.js", "suspected", None),
        ("docs/deep/CONTEXT.md", 1, "../lib/new.js", "suspected", None),  # dots count from the document only
        ("docs/deep/CONTEXT.md", 1, "lib/old.js", "provable", "lib/new.js"),
        ("docs/adr/1.md", 1, "lib/old.js", "historical", None),
        ("pkg/templates/AGENTS.md", 1, "lib/lost.js", "suspected", None),
    }
    own = drift.where("doc = 'docs/AGENTS.md'")
    patch = review.citation_patch(own, docs).first().patch
    assert "+see `lib/new.js` and `lib/new.js`" in patch and patch.count("@@ ") == 1
    counts = review.drift_counts(own).first()
    assert (counts.provable, counts.suspected, counts.historical, counts.gate) == (1, 1, 1, True)
    touched = spark.createDataFrame([("r", "lib/lost.js")], "repo_id string, path string")
    assert {r.doc for r in files.narrow_since(drift, touched).collect()} == {"docs/AGENTS.md", "pkg/templates/AGENTS.md"}


def test_glossary(spark):
    docs = file_text(spark, **{"CONTEXT.md": "# Title\n## Blast Radius\n### `Depth`\n## " + "x" * 50})
    terms = review.glossary_terms(docs)
    changed = spark.createDataFrame([("r", "lib/blast-radius.js"), ("r", "lib/other.js")], "repo_id string, path string")
    assert [r.term for r in review.glossary_hits(changed, terms).collect()] == ["Blast Radius"]
    assert {r.needle for r in terms.collect()} == {"blast-radius", "depth"}


# notes


def test_wikilinks_and_removal(spark):
    texts = {"a.md": "[[B note|alias]] `[[code]]`\n```\n[[fenced]]\n```\n<!-- [[hidden]] -->\n[[c#part]] [[a]]", "b-note.md": "x", "lone.md": ""}
    n = scans.scan_notes(spark.createDataFrame([("v", p, t) for p, t in texts.items()], "vault_id string, path string, text string"))
    links = notes.extract_wikilinks(n)
    assert {(r.src, r.dst) for r in links.collect()} == {("a", "b-note"), ("a", "c")}
    dead, alone = notes.link_gaps(n, links)
    assert [r.dst for r in dead.collect()] == ["c"] and [r.note_id for r in alone.collect()] == ["lone"]


def test_recall_orders_and_limits(spark):
    rows = [("v", "one.md", "alpha beta alpha", 1), ("v", "two.md", "alpha", 2), ("v", "three.md", "gamma", 3)]
    n = spark.createDataFrame(rows, "vault_id string, path string, text string, mtime long")
    assert [r.path for r in notes.recall(n, "alpha beta").collect()] == ["one.md", "two.md"]
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "zz")], "query_id int, query string")
    assert {(r.query_id, r.path) for r in notes.recall_many(n, q).collect()} == {(1, "one.md"), (1, "two.md"), (2, "three.md")}


# enrichment


def test_enrichment(spark):
    batches = spark.createDataFrame([("r", 0, "a"), ("r", 0, "b")], "repo_id string, batch_index int, path string")
    raw = spark.createDataFrame([("r", 0, '{"files": [{"path": "a", "summary": " s ", "role": "Config", "tags": ["X"]}, {"path": "a", "summary": "later"}, {"path": "zz", "summary": "s"}, {"path": "c", "summary": "s", "role": "wizard"}, {"path": "b", "summary": ""}]}'), ("r", 1, "not json")], "repo_id string, batch_no int, text string")
    rows, bad = scans.read_enrichment(raw)
    assert [r.issue for r in bad.collect()] == ["invalid json"]
    f = spark.createDataFrame([("r", p) for p in "abc"], "repo_id string, path string")
    good, issues = enrichment.validate_enrichment(batches, rows, f)
    assert {(r.path, r.summary, r.role) for r in good.collect()} == {("a", "s", "config"), ("c", "s", None)}
    assert {(r.path, r.issue) for r in issues.collect()} == {("a", "duplicate"), ("zz", "unknown path"), ("c", "moved path"), ("c", "unknown role"), ("b", "no summary")}


def test_answers_of_another_shape_are_issues(spark):
    raw = spark.createDataFrame([("r", k, t) for k, t in enumerate(['{"x": 1}', '"text"', "[]", '[1, null, {"path": 3, "summary": "s"}, {"path": "a", "summary": 7}, {"path": "b", "summary": "s", "role": 1, "tags": [1, "A", null, " a\\t"]}]', "{", '{"files": {"path": "a"}}'])], "repo_id string, batch_no int, text string")
    rows, bad = scans.read_enrichment(raw)
    assert {(r.batch_no, r.issue) for r in bad.collect()} == {(0, "no list of entries"), (1, "no list of entries"), (4, "invalid json"), (5, "no list of entries")}
    asked = spark.createDataFrame([("r", k, p) for k in (0, 2, 3) for p in "ab"], "repo_id string, batch_index int, path string")
    good, issues = enrichment.validate_enrichment(asked, rows)
    assert [tuple(r) for r in good.collect()] == [("r", 3, "b", "s", None, ["a"])]
    got = [(r.batch_no, r.path, r.issue) for r in issues.collect()]
    assert sorted(got, key=str) == sorted([(2, "a", "not covered"), (2, "b", "not covered"), (3, "a", "no summary"), (3, "a", "not covered"), *[(3, None, "no path")] * 3], key=str)


def test_the_first_entry_with_a_summary_is_valid(spark):
    raw = spark.createDataFrame([("r", 0, '[{"path": "a"}, {"path": "a", "summary": "\\n docs\\n", "role": "\\u00a0 docs\\n"}, {"path": "a", "summary": "later", "role": "wizard"}, {"path": "z", "summary": "s"}]')], "repo_id string, batch_no int, text string")
    asked = spark.createDataFrame([("r", 0, "a")], "repo_id string, batch_index int, path string")
    good, issues = enrichment.validate_enrichment(asked, scans.read_enrichment(raw)[0])
    assert [(r.path, r.summary, r.role) for r in good.collect()] == [("a", "docs", "docs")]
    assert sorted((r.path, r.issue) for r in issues.collect()) == [("a", "duplicate"), ("a", "no summary"), ("z", "unknown path")]


def test_batches(spark):
    f = spark.createDataFrame([("r", f"src/x/{i}.py", 100, 0) for i in range(5)] + [("r", "docs/a.md", 9000, 0)], "repo_id string, path string, lines int, inbound int")
    packed = enrichment.number_batches(enrichment.pack_batches(f, edges(spark, "src/x/0.py>src/x/4.py"), max_lines=250))
    got = {}
    for r in packed.collect():
        got.setdefault(r.batch_index, []).append(r.path)
    assert sorted(got) == list(range(1, len(got) + 1))
    assert {len(v) for v in got.values()} == {1, 2} and max(sum(100 for _ in v) for k, v in got.items() if k > 1) <= 250
    assert any({"src/x/0.py", "src/x/4.py"} <= set(v) for v in got.values())


# stacks


def test_stack_and_skills(spark):
    ft = file_text(spark, **{"package.json": '{"dependencies": {"next": "1", "stripe": "2", "prisma": "3"}, "description": "react"}', "prisma/schema.prisma": "", "tsconfig.json": "{}", "requirements.txt": "django-x==1\nflask>=2\n", "sub/pom.xml": "<x/>"})
    found = stack.detect_stack(ft.select("repo_id", "path"), scans.read_manifests(ft))
    assert {r.signal_id for r in found.collect()} == {"next", "stripe", "prisma", "typescript", "flask", "python", "java"}
    stats = spark.createDataFrame([("r", 0, 9)], "repo_id string, tests int, files int")
    assert [r.skill_id for r in stack.recommend(found, stats).orderBy("rank").collect()] == ["write-first-test", "verify-webhook", "add-migration", "add-route", "type-check"]


def test_skill_reasons_and_what_exists(spark):
    ft = file_text(spark, **{"package.json": '{"devDependencies": {"jest": "1", "next-auth": "2"}}'})
    found = stack.detect_stack(ft.select("repo_id", "path"), scans.read_manifests(ft))
    stats = spark.createDataFrame([("r", 0, 9)], "repo_id string, tests int, files int")
    table = stack.register_rule(stack.rules.SKILLS, "own-rule", 5, "files > 8", "Own", "concat(files, ' files')")
    got = stack.recommend(found, stats, table)
    assert [(r.skill_id, r.why) for r in got.orderBy("rank").collect()] == [("own-rule", "9 files"), ("write-first-test", "jest is declared, but no file is a test"), ("check-auth", "nextauth keeps the sessions")]
    present, missing = stack.partition_existing(got, spark.createDataFrame([("r", "own-rule")], "repo_id string, skill_id string"))
    assert [r.skill_id for r in present.collect()] == ["own-rule"] and missing.count() == 2


def test_manifest_summaries(spark):
    ft = file_text(spark, **{"package.json": '{"dependencies": {"next": "1", "typescript": "5"}, "scripts": {"test": "vitest"}}', "yarn.lock": "", "package-lock.json": "", "README.md": "# Title\n\nDoes things.\nMore."})
    r = stack.primary_stack(ft).first()
    assert (r.label, r.language) == ("Next.js", "TypeScript")
    assert stack.package_manager(ft).first().manager == "yarn"
    assert [(x.script, x.command) for x in stack.run_commands(scans.read_manifests(ft)).collect()] == [("test", "vitest")]
    assert stack.purpose(ft.where("path = 'README.md'")).first().purpose == "Does things."


# scans, sinks and filters that no table exercises


def test_tracked_lists(spark, tmp_path):
    (tmp_path / "one.tracked").write_bytes(b"bin/run.sh\0a b.py\0bin/run.sh\0")
    assert {(r.repo_id, r.path) for r in scans.read_tracked(spark, str(tmp_path)).collect()} == {("one", "bin/run.sh"), ("one", "a b.py")}


def test_projects_and_memory_files(spark):
    n = spark.createDataFrame([("v", "projects/a.md", "one"), ("v", "projects/b/z.md", "last"), ("v", "projects/b/c.md", "first"), ("v", "projects/.hidden/x.md", ""), ("v", "notes/a.md", "")], "vault_id string, path string, text string")
    assert {r.slug for r in scans.list_projects(n).collect()} == {"a", "b"}
    assert scans.project_context(n, "b").first().context == "first\n\n---\n\nlast"
    m = spark.createDataFrame([("r", "memory/2024-01-02.md", "# 2024-01-02\n\n## 09:05 · note\n\nhello\n\n## 10:00 · decision\n\nyes\nso\n"), ("r", "memory/x.md", "## 09:00 · no\n")], "repo_id string, path string, text string")
    assert [(str(r.ts), r.kind, r.body) for r in scans.memory_from_files(m).orderBy("ts").collect()] == [("2024-01-02 09:05:00", "note", "hello"), ("2024-01-02 10:00:00", "decision", "yes\nso")]


CAPTURE = "ts timestamp, content string, project string, tags array<string>, team string, note_id string, profile string"


def captures(spark):
    day = lambda d, h=10: datetime.datetime(2024, 1, d, h)
    rows = [(day(2), "x", "My Proj", ["A b"], "Core", "n1", "home"), (day(3), "later", "My Proj", None, "Core", "n1", "home"), (day(2), "y", None, None, "Lab 2", "n1", "lab"), (day(2, 11), "second", None, [], None, "n3", None), (day(2, 9), "first", "", ["t"], "", "n4", "lab"), (day(2), "p", "My Proj", None, None, "n5", "home")]
    return spark.createDataFrame(rows, CAPTURE)


def test_captures_are_routed(spark):
    got = {(r.note_id, r.content): (r.dest, r.tag_line, r.pushed, r.note) for r in sinks.route_captures(captures(spark)).collect()}
    assert got == {
        ("n1", "x"): ("team/core/projects/my-proj/2024-01-02-n1.md", "#a-b", True, None),
        ("n1", "later"): ("team/core/projects/my-proj/2024-01-03-n1.md", "", True, None),
        ("n1", "y"): ("team/lab-2/projects/inbox/2024-01-02-n1.md", "", False, "outward_sync_disabled"),
        ("n3", "second"): ("inbox/2024-01-02.md", "", False, None),
        ("n4", "first"): ("inbox/2024-01-02.md", "#t", False, None),
        ("n5", "p"): ("projects/my-proj.md", "", False, None),
    }


def test_captures_are_written_once(spark, tmp_path):
    at = str(tmp_path / "captures")
    for _ in range(2):  # a batch that runs again replaces itself
        sinks.write_captures(captures(spark), at, "1")
    again = captures(spark).where("note_id = 'n1' and content = 'x' or note_id = 'n5'").withColumn("content", F.lit("changed"))
    sinks.write_captures(again, at, "2")
    head = "---\ntype: brain-note\ncreated: 2024-01-02\n---\n"
    assert {r.dest: r.text for r in sinks.read_captures(spark, at).collect()} == {
        "team/core/projects/my-proj/2024-01-02-n1.md": f"{head}\nx #a-b\n",
        "team/core/projects/my-proj/2024-01-03-n1.md": f"{head.replace('-02', '-03')}\nlater\n",
        "team/lab-2/projects/inbox/2024-01-02-n1.md": f"{head}\ny\n",
        "inbox/2024-01-02.md": f"{head}\n- 2024-01-02 — first #t\n\n- 2024-01-02 — second\n",
        "projects/my-proj.md": f"{head}\n- 2024-01-02 — p\n\n- 2024-01-02 — changed\n",
    }


def test_firewall_and_machine_paths(spark):
    p = spark.createDataFrame([("a", "home/work/a"), ("b", "home/own/b")], "slug string, path string")
    assert [r.slug for r in files.firewall(p, ["work"]).collect()] == ["b"]
    assert [r.slug for r in files.firewall_purge(p.select("slug"), p, ["work"]).collect()] == ["a"]
    home = "/ho" + "me/ann/code/x"
    ft = file_text(spark, **{"a.sh": f"cd {home}\ncd /ho" + "me/user/x", "docs/adr/1.md": home, "tests/t.sh": home})
    assert [(r.path, r.line) for r in files.absolute_paths(ft).collect()] == [("a.sh", 1)]
    t = spark.createDataFrame([("r", x) for x in ("a.py", "a.py", "x.bak", "audits/y.md", " ")], "repo_id string, path string")
    assert [r.path for r in files.digest_paths(t).collect()] == ["a.py"]


def test_note_actions_and_stages(spark):
    text = "---\ntype: moc\n---\n## Next actions\n- [ ] call due: 2024-02-01\n- [x] done\n- [ ] rest\n## Later\n- [ ] not this"
    n = spark.createDataFrame([("v", "projects/a.md", text, "2024-01-30", "a"), ("v", "daily/d.md", "[[a]]", "2024-01-30", "d"), ("v", "areas/e.md", "x", "2023-01-01", "e")], "vault_id string, path string, text string, mtime string, note_id string").withColumn("mtime", F.to_timestamp("mtime"))
    actions = notes.open_actions(n)
    assert [(r.action, str(r.due)) for r in actions.orderBy("action").collect()] == [("call due: 2024-02-01", "2024-02-01"), ("rest", "None")]
    assert [r.overdue for r in notes.due_items(actions, F.lit("2024-02-02").cast("date")).collect()] == [True]
    r = notes.vault_score(n, notes.extract_wikilinks(n), F.lit("2024-02-01").cast("date")).first()
    assert (r.capture, r.knowledge, r.context, r.cadence, r.stage) == (20, 10, 0, 20, "Built") and len(r.gaps) == 3
    stay, gone = notes.remove_notes(n, spark.createDataFrame([("v", "a")], "vault_id string, note_id string"), F.lit("2024-02-01 03:04:05").cast("timestamp"))
    assert gone.first().archived_as == "archives/removed/a.20240201-030405.md"
    assert {x.note_id: x.text for x in stay.collect()} == {"d": "a", "e": "x"} and [x.note_id for x in gone.collect()] == ["a"]


def test_digest_with_merges(spark):
    commits = spark.createDataFrame([("r", "2024-01-02", "abc", "fix", "me"), ("r", "2023-01-02", "old", "no", "me"), ("s", "2023-01-02", "old", "no", "me")], "repo_id string, ts string, sha string, subject string, author string").withColumn("ts", F.to_timestamp("ts"))
    merged = spark.createDataFrame([("r", 7, "Title", "2024-01-03")], "repo_id string, number int, title string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.repo_id: r.digest for r in notes.digest(commits, F.lit("2024-01-01").cast("timestamp"), merged).collect()}
    assert got == {"r": "## Digest since 2024-01-01\n\n### Commits\n- abc fix (me, 2024-01-02)\n\n### Merged PRs\n- #7 Title\n", "s": "## Digest since 2024-01-01\n\n### Commits\n- (none)\n"}


def test_recall_within_a_project(spark):
    n = spark.createDataFrame([("v", "projects/fr/a.md", "alpha", 1), ("v", "notes/b.md", "alpha alpha", 2), ("v", "projects/FR.md", "alpha", 3)], "vault_id string, path string, text string, mtime long")
    assert [r.path for r in notes.recall(n, "alpha", project="fr").collect()] == ["projects/FR.md", "projects/fr/a.md"]
    q = spark.createDataFrame([(1, "ana a")], "query_id int, query string")
    t = spark.createDataFrame([("x", "banana Ana an-a", 1), ("y", "", 1), ("z", None, 1)], "path string, text string, mtime long")
    assert [(r.path, r.score) for r in notes.recall_many(t, q).collect()] == [("x", 9)]


def test_depth_refuses_components_that_leave_a_cycle(spark):
    e = edges(spark, "a>b", "b>a")
    own = spark.createDataFrame([("r", "a", "a", False), ("r", "b", "b", False)], "repo_id string, node string, scc string, is_cyclic boolean")
    with pytest.raises(ValueError, match="cycle"):
        graph.depth(e, own)


def test_stack_signals_of_a_file(spark):
    ft = file_text(spark, **{"prisma/schema.prisma": "", "tsconfig.json": "{}", "sub/package.json": '{"x": {"prisma": "1"}}'})
    assert {r.signal_id for r in stack.detect_stack(ft.select("repo_id", "path"), scans.read_manifests(ft)).collect()} == {"typescript", "prisma"}
    alone = ft.where("path = 'prisma/schema.prisma'")
    assert stack.detect_stack(alone.select("repo_id", "path"), scans.read_manifests(alone)).count() == 0


def test_java_roots(spark):
    ft = file_text(spark, **{"src/foo/A.java": "import B;", "src/B.java": ""})
    f = described(ft)
    assert imports.build_edges(imports.resolve_imports(imports.extract_imports(ft), f), f).count() == 0
