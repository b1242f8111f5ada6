"""Registered queries that have no SQL, against brute force over a small folder of tables."""

import random
import re
from collections import Counter, defaultdict

import oracle
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_operators import near_by_hand

from corpuslens.operators import enrichment
from corpuslens.plans import registry


@pytest.fixture(scope="module")
def read(sf_dir):
    return lambda name: pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def part_edges(line):
    at = defaultdict(set)
    for r in line:
        at[r["l_orderkey"], r["l_linenumber"]].add(r["l_partkey"])
    return {(a, b) for (order, n), keys in at.items() for a in keys for b in at.get((order, n + 1), ()) if a != b}


def test_impact_reaches_to_the_end(spark, sf_dir, read):
    back = defaultdict(set)
    for a, b in part_edges(read("lineitem")):
        back[b].add(a)
    parts = {r["p_partkey"]: r["p_name"] for r in read("part")}
    sets = defaultdict(set)
    for k in parts:
        if k % 100 == 0:
            sets[k // 100 % 8].add(k)
    want = {}
    for q, seeds in sets.items():
        seen, frontier, hops = set(seeds), set(seeds), 0
        while frontier:
            hops += 1
            frontier = {a for b in frontier for a in back[b]} - seen
            seen |= frontier
            want |= {(q, k): hops for k in frontier}
    assert max(want.values()) > 2
    got = registry.QUERIES["impact_radius_whole"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r.query_id, r.path): r.hops for r in got} == want
    tested = {n for k, n in parts.items() if k % 10 == 0}
    open_ = {x: h for x, h in want.items() if x[1] % 10 and parts[x[1]] not in tested}
    got = registry.QUERIES["impact_unverified_whole"](spark, sf_dir).collect()
    assert len(got) == len(open_) and {(r.query_id, r.path): r.hops for r in got} == open_


def packed_by_hand(files, edges, max_files=12, max_lines=1500, run_files=4800):
    """{(repo, path): batch_index} of files {(repo, area): {path: (lines, inbound)}}."""
    got, start = {}, Counter()
    for (repo, area), own in sorted(files.items()):
        order = sorted(own, key=lambda p: (-own[p][1], p))
        walk = {}
        for run in (order[i : i + run_files] for i in range(0, len(order), run_files)):
            inside = set(run)

            def visit(p, inside=inside):
                if p not in walk:
                    walk[p] = None
                    for x in sorted(edges.get((repo, p), ())):
                        if x in inside:
                            visit(x)

            for p in run:
                visit(p)
        batch, count, total = start[repo] + 1, 0, 0
        for p in walk:
            if count and (count == max_files or total + own[p][0] > max_lines):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + own[p][0]
            got[repo, p] = batch
        start[repo] = batch
    return got


def test_batches_of_whole_areas(spark, sf_dir, read):
    docs = {r["doc_id"]: r for r in read("documents")}
    area = lambda k: (docs[k]["source"], f"{docs[k]['source']}/{docs[k]['lang']}")
    edges, inbound, files = defaultdict(set), Counter(), defaultdict(dict)
    for a, b in part_edges(read("lineitem")):
        if a in docs and b in docs and area(a) == area(b):
            edges[docs[a]["source"], str(a)].add(str(b))
            inbound[b] += 1
    for k, r in docs.items():
        files[area(k)][str(k)] = (r["n_chars"] // 80, inbound[k])
    got = {(r.repo_id, r.path): r.batch_index for r in registry.QUERIES["pack_batches"](spark, sf_dir).collect()}
    assert got == packed_by_hand(files, edges) and edges
    assert max(Counter((r, b) for (r, _), b in got.items()).values()) > 1


def test_hot_area_is_packed_in_runs(spark):
    rng = random.Random(3)
    own = {f"p{i:03}": (rng.randrange(1, 400), rng.randrange(4)) for i in range(150)}
    files = {("r", "hot"): own, ("r", "a"): {"q": (10, 0)}, ("s", "hot"): {"p000": (5000, 0), "p001": (1, 0)}}
    edges = defaultdict(set)
    for _ in range(300):
        a, b = rng.sample(sorted(own), 2)
        edges["r", a].add(b)
    f = spark.createDataFrame([(r, a, p, n, i) for (r, a), x in files.items() for p, (n, i) in x.items()], "repo_id string, area_id string, path string, lines int, inbound long").repartition(3)
    e = spark.createDataFrame([(r, a, b) for (r, a), x in edges.items() for b in x], "repo_id string, src string, dst string")
    for run_files in (40, 4800):
        rows = enrichment.number_batches(enrichment.pack_batches(f, e, area_col="area_id", run_files=run_files)).collect()
        assert len(rows) == 153 and {(r.repo_id, r.path): r.batch_index for r in rows} == packed_by_hand(files, edges, run_files=run_files)
        assert sorted(r.pos for r in rows if r.repo_id == "r" and r.area == "hot") == list(range(150))


def test_batches_of_an_area_of_twenty_thousand_files(spark):
    """Batches go on through the ends of walks: the same as closing them one file after the other."""
    rng = random.Random(9)
    own = {f"p{i:05}": (rng.choice([0, 5, 90, 130, 400, 700, 1500, 4000]), 0) for i in range(20_000)}
    f = spark.createDataFrame([("r", "hot", p, n, i) for p, (n, i) in own.items()], "repo_id string, area_id string, path string, lines int, inbound long").repartition(5)
    e = spark.createDataFrame([], "repo_id string, src string, dst string")
    rows = enrichment.number_batches(enrichment.pack_batches(f, e, area_col="area_id")).collect()
    assert len(rows) == 20_000 and {(r.repo_id, r.path): r.batch_index for r in rows} == packed_by_hand({("r", "hot"): own}, {})
    ordered = spark.createDataFrame([("r", "hot", i, n) for i, (n, _) in enumerate(own.values())], "repo_id string, area string, pos long, lines int")
    want = {(r.pos, r.next, r.local_batch) for r in enrichment.batch_starts(ordered.where("pos < 500")).collect()}
    assert want == {(r.pos, r.next, r.local_batch) for r in enrichment.batch_starts(ordered.where("pos < 500"), stretch=13).collect()}


def test_near_duplicates_of_the_query(spark, sf_dir, read):
    links, classes = near_by_hand([(r["doc_id"], r["text"]) for r in read("documents")])
    got = {r.doc_id: r.class_id for r in registry.QUERIES["duplicates_near"](spark, sf_dir).collect()}
    assert links and sum(got.get(a, -1) == got.get(b, -2) for a, b in links) >= 0.9 * len(links)
    assert len(got) >= 0.9 * len(classes) and all(classes[i] == classes[c] for i, c in got.items())


def test_recall_with_every_word(spark, sf_dir, read):
    texts = [(r["doc_id"], r["n_chars"], (r["text"] or "").lower()) for r in read("documents")]
    counts, want, longest = {}, set(), 0
    for q in read("benchmark"):
        words = Counter(re.findall("[a-z0-9]+", q["text"].lower()))
        longest = max(longest, sum(words.values()))
        for w in words:
            if w not in counts:
                counts[w] = [t.count(w) for _, _, t in texts]
        scores = [sum(n * counts[w][i] for w, n in words.items()) for i in range(len(texts))]
        best = sorted((-s, -texts[i][1], texts[i][0]) for i, s in enumerate(scores) if s)[:8]
        want |= {(q["item_id"], d, -s, k) for k, (s, _, d) in enumerate(best, 1)}
    assert longest > 3
    got = registry.QUERIES["recall_many_whole"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r.item_id, r.doc_id, r.score, r.rank) for r in got} == want


def test_components_of_the_part_graph(spark, sf_dir, read):
    """Two depth-first passes, one along the edges and one against them."""
    pairs = part_edges(read("lineitem"))
    nodes = {x for p in pairs for x in p}
    forth, back = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        forth[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for start in nodes:
        stack = [(start, False)]
        while stack:
            x, left = stack.pop()
            if left:
                order.append(x)
            elif x not in seen:
                seen.add(x)
                stack += [(x, True), *((y, False) for y in forth[x])]
    comp, named = defaultdict(set), {}
    for start in reversed(order):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in named:
                named[x] = start
                comp[start].add(x)
                stack += back[x]
    got = {r.p_partkey: (r.scc, r.is_cyclic) for r in registry.QUERIES["scc"](spark, sf_dir).collect()}
    assert got == {x: (max(comp[c]), len(comp[c]) > 1) for x, c in named.items()}


def test_layers_hold_every_row_of_the_supply_tables(spark, sf_dir, read):
    """By a walk down from each node; orders without lines need nothing."""
    keys = {"o": ("orders", "o_orderkey"), "p": ("part", "p_partkey"), "s": ("supplier", "s_suppkey"), "n": ("nation", "n_nationkey"), "r": ("region", "r_regionkey")}
    nodes = {f"{letter}{r[c]}" for letter, (name, c) in keys.items() for r in read(name)}
    down = defaultdict(set)
    for r in read("lineitem"):
        down[f"o{r['l_orderkey']}"].add(f"p{r['l_partkey']}")
        down[f"p{r['l_partkey']}"].add(f"s{r['l_suppkey']}")
    for r in read("supplier"):
        down[f"s{r['s_suppkey']}"].add(f"n{r['s_nationkey']}")
    for r in read("nation"):
        down[f"n{r['n_nationkey']}"].add(f"r{r['n_regionkey']}")
    level = lambda x: 1 + max(map(level, down[x] & nodes), default=-1)
    listed = defaultdict(list)
    for x in nodes:
        listed[level(x)].append(x)
    want = [(d, len(listed[d]), k, x) for d in sorted(listed) for k, x in enumerate(sorted(listed[d]), 1)]
    assert any(x[0] == "o" for x in listed[0])
    assert [tuple(r)[:4] for r in registry.QUERIES["layers"](spark, sf_dir).collect()] == want


def test_layers_of_odd_tables(spark, sf_dir, tmp_path):
    """Rows repeat, lines name parts and suppliers that are not there, keys are null, a supplier has no nation."""
    for name in ("orders", "lineitem", "part", "supplier", "nation", "region"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        key = df.columns[0]
        rows = df.unionByName(df.limit(3)).unionByName(df.limit(1).withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
        if name in ("part", "supplier"):
            rows = rows.where(F.col(key).isNull() | (F.col(key) % 7 != 3))
        if name == "lineitem":
            rows = rows.withColumn("l_partkey", F.when(F.col("l_linenumber") != 5, F.col("l_partkey")))
        if name == "supplier":
            rows = rows.withColumn("s_nationkey", F.when(F.col(key) % 2 == 0, 99).otherwise(F.col("s_nationkey")).cast("int"))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.QUERIES["layers"](spark, str(tmp_path))
    assert oracle.differences(got, registry.ORACLE_SQL["layers"], oracle.connect(str(tmp_path))) == ""
    assert {r.depth for r in got.collect()} == {0, 1, 2, 3, 4}
