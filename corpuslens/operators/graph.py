"""Graph operators over edges(repo_id, src, dst): many graphs at a time, keyed by repo_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import broadcast_if_small, settle, shuffled, tasks_for


def with_inbound(f: DataFrame, e: DataFrame) -> DataFrame:
    counts = e.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("inbound"))
    return f.join(shuffled(counts), ["repo_id", "path"], "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))


def orphans(f: DataFrame, e: DataFrame, blind: list[str] = ()) -> DataFrame:
    """Code that nothing imports and that imports nothing, apart from tests, entries and blind languages."""
    able = f.where("category = 'code' and not is_test and not is_entry").where(~F.col("lang").isin(list(blind)) if blind else F.lit(True))
    for end in ("src", "dst"):
        able = able.join(shuffled(e.select("repo_id", F.col(end).alias("path"))), ["repo_id", "path"], "left_anti")
    return able


def impact(e: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Reverse breadth-first searches from seeds(query_id, repo_id, path): fewest hops, seeds left out.

    A round is one join of the frontier with the edges; what was seen is anti-joined, so cycles end.
    Every search has a limit of its own if seeds have a column max_depth (null: none; of several, the
    largest), else max_depth is that of all; a search that is over leaves the frontier. The second table
    has query_id and truncated: whether the limit cut anything off.
    """
    back = settle(e.select("repo_id", "src", "dst").distinct(), "impact-edges")
    keys = ["query_id", "repo_id", "path"]
    own = F.col("max_depth") if "max_depth" in seeds.columns else F.lit(max_depth)
    limits = seeds.groupBy("query_id").agg(F.max(own.cast("int")).alias("most"))
    frontier = settle(seeds.select(*keys).distinct().join(limits, "query_id").select(*keys, "most", F.lit(0).alias("hops")), "seeds")
    seen, cut, depth = frontier, frontier.select("query_id").limit(0), 0
    while frontier.take(1):
        depth += 1
        near = frontier.join(back, (frontier["repo_id"] == back["repo_id"]) & (frontier["path"] == back["dst"])).select("query_id", frontier["repo_id"], F.col("src").alias("path"), "most").distinct()
        step = settle(near.join(seen, keys, "left_anti").withColumn("hops", F.lit(depth)), "frontier")
        beyond = F.coalesce(F.col("hops") > F.col("most"), F.lit(False))
        frontier, over = step.where(~beyond), step.where(beyond).select("query_id").distinct()
        seen, cut = seen.unionByName(frontier), cut.unionByName(over)
        if depth % 8 == 0:  # a long search must not carry all its rounds in one plan
            seen, cut = settle(seen, "seen"), settle(cut.distinct(), "cut")
    searches = limits.join(cut.distinct().withColumn("truncated", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return seen.where("hops > 0").select(*keys, "hops"), searches


def order_impact(found: DataFrame, f: DataFrame) -> DataFrame:
    """Nearest first, then the most changed."""
    rows = found.join(f.select("repo_id", "path", "commits", "is_test"), ["repo_id", "path"], "left")
    return rows.orderBy("query_id", "hops", F.desc("commits"), "path")


def _nodes(e: DataFrame) -> DataFrame:
    return e.select("repo_id", F.col("src").alias("node")).unionByName(e.select("repo_id", F.col("dst").alias("node"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of links(src, dst), whatever their direction.

    Large and small stars in turn: every node's larger neighbours, then its smaller ones, are tied to the
    least of them, until nothing moves; a round is two grouped tables, and rounds grow with the logarithm
    of the longest way. Least neighbours are map-side aggregates joined back, so no group is collected.
    """
    edges = settle(links.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = settle(large.unionByName(least.where("least < a").select("a", F.col("least").alias("b"))).where("a != b").distinct(), "large-stars")
        centre = settle(large.groupBy("a").agg(F.min("b").alias("least")), "centres")
        small = large.join(centre, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = settle(small.unionByName(centre.select("a", F.col("least").alias("b"))).where("a != b").distinct(), "small-stars")
        if not small.join(edges, ["a", "b"], "left_anti").take(1) and not edges.join(small, ["a", "b"], "left_anti").take(1):
            break
        edges = small
    tied = edges.groupBy("a").agg(F.min("b").alias("component"))
    return tied.select(F.col("a").alias("node"), "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _peel(e: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """repo_id, node, level of the nodes below which there is no cycle, and the settled edges that stay for ever.

    A round takes nodes that have no edges of their own left: sinks, then what is a sink without them,
    and so on, so that a node's level is the length of its longest way down. It reads the edges to the
    nodes of the round before and writes what the waiting nodes still have; edges are never rewritten.
    What stays leads into a cycle.
    """
    ends = e.select("repo_id", F.col("src").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("into")).unionByName(e.select("repo_id", F.col("dst").alias("node"), F.lit(0).alias("own"), F.lit(1).alias("into")))
    waiting = settle(ends.groupBy("repo_id", "node").agg(F.sum("own").alias("own"), F.sum("into").alias("into")), name)
    done, level = waiting.where("own = 0").select("repo_id", "node", F.lit(0).alias("level")), 0
    if not done.take(1):
        return done, e
    while True:
        ready, waiting = waiting.where("own = 0 and into > 0").select("repo_id", F.col("node").alias("dst")), waiting.where("own > 0")
        if not ready.take(1):
            break
        level += 1
        gone = e.join(broadcast_if_small(ready), ["repo_id", "dst"]).groupBy("repo_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("gone"))
        waiting = settle(waiting.join(shuffled(gone), ["repo_id", "node"], "left").select("repo_id", "node", (F.col("own") - F.coalesce("gone", F.lit(0))).alias("own"), "into"), name)
        done = done.unionByName(waiting.where("own = 0").select("repo_id", "node", F.lit(level).alias("level")))
        if level % 8 == 0:  # a long way down must not carry all its rounds in one plan
            done = settle(done, name)
    left = waiting.select("repo_id", F.col("node").alias("dst"))
    return done, settle(e.join(shuffled(left), ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst"), name)


def _turned(e: DataFrame) -> DataFrame:
    return e.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def scc(e: DataFrame) -> DataFrame:
    """repo_id, node, scc (its largest node), is_cyclic for all nodes of the edges.

    Nodes that lie on no way from a cycle to a cycle are alone. Of the rest, each takes the largest
    label that reaches it; nodes of one colour that reach the node of that name form its component.
    Both are joins repeated until nothing changes, and every round retires at least one component of
    each repository that still has a cycle.
    """
    whole = settle(e.where("src != dst").select("repo_id", "src", "dst").distinct(), "scc-edges")
    left, done = whole, None
    while True:
        left = _turned(_peel(_turned(_peel(left, "scc-peel")[1]), "scc-peel")[1])
        if not left.take(1):
            break
        first = left.select("repo_id", F.col("dst").alias("node"), F.col("src").alias("seen")).unionByName(left.select("repo_id", F.col("src").alias("node"), F.col("src").alias("seen")))
        colour = first.groupBy("repo_id", "node").agg(F.max("seen").alias("seen")).select("repo_id", "node", F.greatest("node", "seen").alias("colour"), (F.col("seen") > F.col("node")).alias("moved"))
        colour = settle(colour, "scc-colour")
        while True:  # forward: the largest label, pushed by nodes that got a larger one in the round before
            moved = colour.where("moved").select("repo_id", F.col("node").alias("src"), "colour")
            if not moved.take(1):
                break
            pushed = left.join(broadcast_if_small(moved), ["repo_id", "src"]).groupBy("repo_id", F.col("dst").alias("node")).agg(F.max("colour").alias("seen"))
            colour = settle(colour.join(shuffled(pushed), ["repo_id", "node"], "left").select("repo_id", "node", F.greatest("colour", "seen").alias("colour"), F.coalesce(F.col("seen") > F.col("colour"), F.lit(False)).alias("moved")), "scc-colour")
        colour = colour.select("repo_id", "node", "colour")
        members = frontier = settle(colour.where("node = colour"), "scc-roots")
        while True:  # backward within a colour
            step = left.join(broadcast_if_small(frontier.withColumnRenamed("node", "dst")), ["repo_id", "dst"]).select("repo_id", F.col("src").alias("node"), "colour").distinct()
            step = step.join(shuffled(colour), ["repo_id", "node", "colour"], "left_semi").join(shuffled(members), ["repo_id", "node"], "left_anti")
            frontier = settle(step, "scc-back")
            if not frontier.take(1):
                break
            members = members.unionByName(frontier)
        members = settle(members, "scc-members")
        done = members if done is None else done.unionByName(members)
        for end in ("src", "dst"):
            left = left.join(shuffled(members.select("repo_id", F.col("node").alias(end))), ["repo_id", end], "left_anti")
        left = settle(left.select("repo_id", "src", "dst"), "scc-left")
    nodes = _nodes(whole)
    if done is None:
        return nodes.select("repo_id", "node", F.col("node").alias("scc"), F.lit(False).alias("is_cyclic"))
    size = done.groupBy("repo_id", "colour").agg(F.count(F.lit(1)).alias("size"))
    found = done.join(size, ["repo_id", "colour"])
    out = nodes.join(found, ["repo_id", "node"], "left")
    return out.select("repo_id", "node", F.coalesce("colour", "node").alias("scc"), (F.coalesce("size", F.lit(1)) > 1).alias("is_cyclic"))


def depth(e: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """repo_id, node, depth, scc, is_cyclic: the longest path down the condensation; 0 imports nothing.

    Components are looked for only among what leads into a cycle. Given components that leave a cycle
    between them are an error.
    """
    edges = whole = settle(e.where("src != dst").select("repo_id", "src", "dst").distinct(), "depth-edges")
    levels, rest = _peel(edges, "depth-peel")
    if components is None and not rest.take(1):
        return levels.select("repo_id", "node", F.col("level").alias("depth"), F.col("node").alias("scc"), F.lit(False).alias("is_cyclic"))
    own = components if components is not None else scc(rest)
    comp = settle(own.select("repo_id", "node", "scc", "is_cyclic"), "depth-scc")
    for end, name in (("src", "a"), ("dst", "b")):
        whole = whole.join(shuffled(comp.select("repo_id", F.col("node").alias(end), F.col("scc").alias(name))), ["repo_id", end], "left").withColumn(name, F.coalesce(name, end))
    links = settle(whole.where("a != b").select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "depth-links")
    levels, rest = _peel(links, "depth-peel")
    if rest.take(1):
        raise ValueError("the components leave a cycle between them")
    levels = settle(levels.select("repo_id", F.col("node").alias("scc"), F.col("level").alias("depth")), "depth-levels")
    named = _nodes(edges).join(shuffled(comp), ["repo_id", "node"], "left").select("repo_id", "node", F.coalesce("scc", "node").alias("scc"), F.coalesce("is_cyclic", F.lit(False)).alias("is_cyclic"))
    return named.join(shuffled(levels), ["repo_id", "scc"], "left").select("repo_id", "node", F.coalesce("depth", F.lit(0)).alias("depth"), "scc", "is_cyclic")


def leveled(f: DataFrame, e: DataFrame) -> DataFrame:
    """repo_id, path, depth, is_cyclic of every file of f(repo_id, path) by the edges between them.

    Edges to or from what is no file of f don't count; a file without any other edge has depth 0.
    """
    f, inside = f.select("repo_id", "path"), e.select("repo_id", "src", "dst")
    n = tasks_for(e.sparkSession, e.count())
    for end in ("src", "dst"):
        known = f.withColumnRenamed("path", end).repartition(n, "repo_id", end).distinct()
        inside = inside.repartition(n, "repo_id", end).join(shuffled(known), ["repo_id", end])
    found = depth(inside).select("repo_id", F.col("node").alias("path"), "depth", "is_cyclic")
    return f.distinct().join(shuffled(found), ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("is_cyclic", F.lit(False)).alias("is_cyclic"))


def layers(depths: DataFrame) -> DataFrame:
    """repo_id, depth, files, place, path, is_cyclic: the sorted list of the paths of each layer of depths(repo_id, path, depth, is_cyclic).

    A layer may hold most of all files, so its list is rows: files is its length, place (from 1) where a
    path stands in it. Places come from a range partitioning and the sizes of its partitions.
    """
    order = ["repo_id", "depth", "path"]
    rows = settle(depths.select(*order, "is_cyclic"), "layers")
    ranged = rows.repartitionByRange(tasks_for(rows.sparkSession, rows.count()), *order).sortWithinPartitions(*order)
    ranged = settle(ranged.withColumn("at", F.monotonically_increasing_id()), "layers-ranged").withColumn("part", F.shiftright("at", 33))
    layer = Window.partitionBy("repo_id", "depth")
    before = layer.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy("repo_id", "depth", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    pieces = settle(pieces.select("repo_id", "depth", "part", F.sum("n").over(layer).alias("files"), start.alias("start")), "layers-pieces")
    placed = ranged.join(broadcast_if_small(pieces), ["repo_id", "depth", "part"])
    return placed.select("repo_id", "depth", "files", (F.col("at") + F.col("start")).alias("place"), "path", "is_cyclic")


def _ends(hop: DataFrame, most: int) -> DataFrame:
    """repo_id, old_path, final_path of hop(repo_id, old_path, new_path), followed to the end or for most steps at least.

    Each round doubles how far every pointer has gone; a row is a pointer and stays so.
    """
    links, far = hop.select("repo_id", "old_path", F.col("new_path").alias("final_path"), F.lit(True).alias("moved")), 1
    while far <= most and links.where("moved").take(1):
        ahead = links.select("repo_id", F.col("old_path").alias("final_path"), F.col("final_path").alias("further"))
        joined = links.join(ahead, ["repo_id", "final_path"], "left")
        links = settle(joined.select("repo_id", "old_path", F.coalesce("further", "final_path").alias("final_path"), F.col("further").isNotNull().alias("moved")), "renames")
        far *= 2
    return links.drop("moved")


def follow_renames(renames: DataFrame) -> DataFrame:
    """repo_id, old_path, final_path: the newest record of each source, followed to its end.

    A chain that runs into a cycle ends where it meets it; paths on a cycle end nowhere and are left out.
    """
    newest = F.row_number().over(Window.partitionBy("repo_id", "old_path").orderBy("seq"))
    hop = settle(renames.withColumn("n", newest).where("n = 1 and old_path != new_path").select("repo_id", "old_path", "new_path"), "renames")
    most = hop.groupBy("repo_id").count().agg(F.max("count")).first()[0] or 0
    ends = _ends(hop, most)
    # where a pointer still can go on after as many steps as there are records, it has come to lie on a cycle
    cyclic = ends.join(hop.select("repo_id", F.col("old_path").alias("final_path")), ["repo_id", "final_path"], "left_semi").select("repo_id", F.col("final_path").alias("old_path")).distinct()
    cyclic = settle(cyclic, "rename-cycles")
    return _ends(hop.join(cyclic, ["repo_id", "old_path"], "left_anti"), most) if cyclic.take(1) else ends


def coverage_of(radius: DataFrame, cov: DataFrame) -> DataFrame:
    return radius.join(cov, ["repo_id", "path"], "left")


def unverified(found: DataFrame, f: DataFrame, cov: DataFrame) -> DataFrame:
    """The radius without tests and without what a test covers."""
    plain = found.join(f.where("is_test").select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    return plain.join(cov.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def suggested_tests(found: DataFrame, seeds: DataFrame, f: DataFrame, cov: DataFrame) -> DataFrame:
    """Tests in the radius, and tests that cover the radius or a seed."""
    inside = found.join(f.where("is_test").select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("query_id", "repo_id", F.col("path").alias("test"))
    named = found.select("query_id", "repo_id", "path").unionByName(seeds.select("query_id", "repo_id", "path"))
    covering = named.join(cov, ["repo_id", "path"]).select("query_id", "repo_id", F.explode("tests").alias("test"))
    return inside.unionByName(covering).distinct()


def suggested_by_class(found: DataFrame, seeds: DataFrame, f: DataFrame, code: DataFrame, tests: DataFrame) -> DataFrame:
    """``suggested_tests`` by the classes of ``coverage.name_classes``: a search meets the tests of a stem once, however many files of it it reaches."""
    inside = found.join(f.where("is_test").select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("query_id", "repo_id", F.col("path").alias("test"))
    named = found.select("query_id", "repo_id", "path").unionByName(seeds.select("query_id", "repo_id", "path"))
    stems = named.join(code, ["repo_id", "path"]).select("query_id", "repo_id", "stem").distinct()
    return inside.unionByName(stems.join(tests, ["repo_id", "stem"]).select("query_id", "repo_id", "test")).distinct()


def batch_neighbours(batches: DataFrame, e: DataFrame) -> DataFrame:
    """What a batch's files import or are imported by, outside the batch."""
    b = batches.select("repo_id", "batch_index", "path")
    e = settle(e.select("repo_id", "src", "dst"), "neighbour-edges")
    n = tasks_for(e.sparkSession, 2 * e.count())
    out, back = (e.select("repo_id", F.col(here).alias("path"), F.col(there).alias("near")).repartition(n, "repo_id", "path").join(shuffled(b), ["repo_id", "path"]) for here, there in (("src", "dst"), ("dst", "src")))
    both = out.unionByName(back).select("repo_id", "batch_index", F.col("near").alias("path")).repartition(n, "repo_id", "batch_index", "path").distinct()
    return both.join(shuffled(b), ["repo_id", "batch_index", "path"], "left_anti")


def forbidden_edges(e: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Edges from an area to one that forbidden(from_area, to_area) names; e has src_area and dst_area."""
    return e.join(forbidden, (F.col("src_area") == F.col("from_area")) & (F.col("dst_area") == F.col("to_area")), "left_semi")
