"""Batches of files to be described, and what comes back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..tables import settle, shuffled, tasks_for

#: Files of an area that are walked together.
RUN_FILES = 4800
AREA = ["repo_id", "area"]


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the later ones."""
    ranked = df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("nth = 1").drop("nth"), ranked.where("nth > 1").drop("nth")


def validate_enrichment(batches: DataFrame, results: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows and issues of results(repo_id, batch_no, pos, path, summary, role, tags), as ``scans.read_enrichment`` gives them.

    Of a path's entries in a batch, the first one with a summary is valid, those before it have an issue
    and those after it are duplicates. A path of another batch is kept and noted if files has it; an
    unknown one is dropped, as is every path outside its batch when no files are given. Then, too, each
    path that an answered batch asked for and that has no valid entry is an issue: with files, a gap may
    well be filled from another batch. An unknown role is cleared.
    """
    keys = ["repo_id", "batch_no", "path"]
    asked = batches.select("repo_id", F.col("batch_index").alias("batch_no"), "path").distinct()
    rows = results.where("pos is not null").join(asked.withColumn("asked", F.lit(True)), keys, "left")
    if files is None:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(files.select("repo_id", "path").distinct().withColumn("known", F.lit(True)), ["repo_id", "path"], "left")
    rows = rows.withColumns({"asked": F.col("asked").isNotNull(), "known": F.col("known").isNotNull(), "summary": C.clean_summary("summary"), "cleared": C.clean_role("role")})
    named, told = F.coalesce(F.col("path").cast("string") != "", F.lit(False)), F.coalesce(F.col("summary") != "", F.lit(False))
    rows = rows.withColumn("in_scope", named & (F.col("asked") | F.col("known"))).withColumn("is_valid", F.col("in_scope") & told)
    first = F.min(F.when(F.col("is_valid"), F.col("pos"))).over(Window.partitionBy(*keys))  # entries of one path in one answer
    rows = rows.withColumn("first", first)
    later, valid = F.coalesce(F.col("pos") > F.col("first"), F.lit(False)), F.coalesce(F.col("pos") == F.col("first"), F.lit(False))
    issue = F.array_compact(
        F.array(
            F.when(~named, F.lit("no path")),
            F.when(named & ~F.col("in_scope"), F.lit("unknown path")),
            F.when(F.col("in_scope") & ~F.col("asked"), F.lit("moved path")),
            F.when(F.col("in_scope") & later, F.lit("duplicate")),
            F.when(F.col("in_scope") & ~later & ~told, F.lit("no summary")),
            F.when(valid & (C.strip("role") != "") & F.col("cleared").isNull(), F.lit("unknown role")),
        )
    )
    issues = rows.select(*keys, F.explode(issue).alias("issue"))
    good = rows.where(valid).select(*keys, "summary", F.col("cleared").alias("role"), C.clean_tags("tags").alias("tags"))
    if files is None:
        answered = results.select("repo_id", "batch_no").distinct()
        gaps = asked.join(answered, ["repo_id", "batch_no"], "left_semi").join(good, keys, "left_anti")
        issues = issues.unionByName(gaps.select(*keys, F.lit("not covered").alias("issue")))
    return good, issues


def merge_enrichment(files: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last batch's row of each path, and coverage by repository."""
    merged = valid.groupBy("repo_id", "path").agg(F.max_by(F.struct("summary", "role", "tags"), "batch_no").alias("x")).select("repo_id", "path", "x.*")
    marked = files.join(merged.select("repo_id", "path").withColumn("done", F.lit(True)), ["repo_id", "path"], "left")
    return merged, marked.groupBy("repo_id").agg(F.count_if("done").alias("enriched"), F.count(F.lit(1)).alias("indexed"))


def uncovered(batches: DataFrame, merged: DataFrame) -> DataFrame:
    return batches.select("repo_id", "path").join(merged, ["repo_id", "path"], "left_anti")


def apply_enrichment(f: DataFrame, merged: DataFrame) -> DataFrame:
    return f.join(merged.select("repo_id", "path", "summary", "role", "tags"), ["repo_id", "path"], "left")


def is_stale(index_meta: DataFrame, enrichment_meta: DataFrame) -> DataFrame:
    """repo_id, stale: another commit or count than the index has, or no enrichment at all."""
    e = enrichment_meta.select("repo_id", F.col("commit").alias("e_commit"), F.col("indexed").alias("e_indexed"))
    same = F.col("commit").eqNullSafe(F.col("e_commit")) & F.col("files").eqNullSafe(F.col("e_indexed"))
    return index_meta.join(e, "repo_id", "left").select("repo_id", (~same).alias("stale"))


def cohesion_order(f: DataFrame, e: DataFrame, area_col: str | None = None, run_files: int = RUN_FILES) -> DataFrame:
    """repo_id, area, path, lines, pos: the files of each area, depth first along their imports from the most imported one.

    The walk is sequential, so it is taken in pandas groups: an area's files, the most imported first, are
    cut into runs of run_files, and a walk ends with its run; an area of no more files is one walk. pos
    goes on through an area's runs. Ranks come from a range partitioning and the sizes of its partitions.
    """
    area = F.col(area_col) if area_col else C.area_key("path")
    order = [F.col("repo_id"), F.col("area"), F.desc("inbound"), F.col("path")]
    rows = f.withColumn("area", area).select("repo_id", "area", "path", "lines", "inbound")
    ranged = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "pack-ranged")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy(*AREA).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy(*AREA, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    pieces = pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).drop("n", "first")
    placed = ranged.join(pieces, [*AREA, "part"]).withColumn("rank", F.col("at") + F.col("start"))
    placed = settle(placed.select(*AREA, "path", "lines", "inbound", F.floor(F.col("rank") / run_files).alias("run")), "pack-placed")
    end = lambda name, a, r: placed.select("repo_id", F.col("path").alias(name), F.col("area").alias(a), F.col("run").alias(r))
    near = e.join(end("src", "a", "ra"), ["repo_id", "src"]).join(end("dst", "b", "rb"), ["repo_id", "dst"]).where("a = b and ra = rb")
    links = near.groupBy("repo_id", F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["inbound", "path"], ascending=[False, True])
        out = {p: list(x) if x is not None else [] for p, x in zip(pdf["path"], pdf["imports"], strict=True)}
        size, order, seen = dict(zip(pdf["path"], pdf["lines"], strict=True)), [], set()
        for start in pdf["path"]:
            stack = [start]
            while stack:
                p = stack.pop()
                if p not in seen:
                    seen.add(p)
                    order.append(p)
                    stack += [x for x in reversed(out[p]) if x in out]
        first = pdf.iloc[0]
        return pd.DataFrame({"repo_id": first["repo_id"], "area": first["area"], "path": order, "lines": [size[p] for p in order], "pos": first["run"] * run_files + np.arange(len(order))})

    walked = placed.join(links, ["repo_id", "path"], "left").groupBy(*AREA, "run")
    return walked.applyInPandas(walk, placed.select(*AREA, "path", "lines", F.lit(0).cast("long").alias("pos")).schema)


def batch_starts(ordered: DataFrame, max_files: int = 12, max_lines: int = 1500, stretch: int = 10_000) -> DataFrame:
    """repo_id, area, pos, next, local_batch: where each batch of ordered(repo_id, area, pos, lines) begins and the next one would.

    A batch is closed at max_files files, or before the file that would bring it over max_lines; a larger
    file is a batch of its own. So where a batch that begins at a file ends follows from the max_files
    files after it, and the batches of an area are the orbit of its first file, found by pointer doubling:
    in each round all starts known so far jump as many batches as there have been, and pointers double.
    Windows look ahead in stretches of positions, each with the first files of the next one.
    """
    own = F.floor(F.col("pos") / stretch)
    early = (F.col("pos") % stretch < max_files) & (own > 0)
    shared = ordered.select(*AREA, "pos", "lines", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))).alias("stretch"))
    ahead = Window.partitionBy(*AREA, "stretch").orderBy("pos").rowsBetween(Window.currentRow, max_files - 1)
    sums = F.aggregate("ahead", F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"), F.lit(True).alias("going")), lambda a, x: F.struct((a["total"] + x).alias("total"), (a["n"] + F.when(a["going"] & ((a["n"] == 0) | (a["total"] + x <= max_lines)), 1).otherwise(0)).alias("n"), (a["going"] & ((a["n"] == 0) | (a["total"] + x <= max_lines))).alias("going")))
    rows = shared.withColumn("ahead", F.collect_list("lines").over(ahead)).where(F.col("stretch") == own)
    first = settle(rows.select(*AREA, "pos", (F.col("pos") + sums["n"]).alias("next")), "batch-next")
    jumps, far = first, 1
    starts = settle(first.where("pos = 0").select(*AREA, "pos", F.lit(0).cast("long").alias("local_batch")), "batch-starts")
    while True:
        landed = starts.join(jumps, [*AREA, "pos"]).select(*AREA, F.col("next").alias("pos"), (F.col("local_batch") + far).alias("local_batch"))
        landed = settle(landed.join(first.select(*AREA, "pos"), [*AREA, "pos"], "left_semi"), "batch-landed")
        if not landed.take(1):
            break
        starts = settle(starts.unionByName(landed), "batch-starts")
        beyond = jumps.select(*AREA, F.col("pos").alias("next"), F.col("next").alias("further"))
        jumps, far = settle(jumps.join(beyond, [*AREA, "next"]).select(*AREA, "pos", F.col("further").alias("next")), "batch-jumps"), 2 * far
    return starts.join(first, [*AREA, "pos"]).select(*AREA, "pos", "next", "local_batch")


def pack_batches(f: DataFrame, e: DataFrame, max_files: int = 12, max_lines: int = 1500, area_col: str | None = None, run_files: int = RUN_FILES) -> DataFrame:
    """repo_id, area, path, pos, local_batch: greedy batches inside each area, of any size, in cohesion order."""
    ordered = settle(cohesion_order(f, e, area_col, run_files), "pack-ordered")
    starts = batch_starts(ordered, max_files, max_lines)
    held = starts.select(*AREA, F.explode(F.sequence("pos", F.col("next") - 1)).alias("pos"), "local_batch")  # max_files at most
    return ordered.join(held, [*AREA, "pos"]).select(*AREA, "path", "pos", "local_batch")


def number_batches(packed: DataFrame) -> DataFrame:
    """batch_index from 1 over a repository's areas in order: a prefix sum of the areas' batch counts."""
    keys = ["repo_id", "area"]
    counts = packed.groupBy(*keys).agg((F.max("local_batch") + 1).alias("n"))
    before = Window.partitionBy("repo_id").orderBy("area").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return packed.join(starts, keys).withColumn("batch_index", F.col("start") + F.col("local_batch") + 1).drop("start")


def batch_stats(batches: DataFrame, f: DataFrame) -> DataFrame:
    n = tasks_for(batches.sparkSession, batches.count())
    own, sized = (df.repartition(n, "repo_id", "path") for df in (batches.select("repo_id", "batch_index", "path"), f.select("repo_id", "path", "lines")))
    sizes = own.join(shuffled(sized), ["repo_id", "path"]).select("repo_id", "batch_index", "lines").repartition(n, "repo_id", "batch_index").groupBy("repo_id", "batch_index").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
    return sizes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("batches"), F.sum("files").alias("files"), F.max("files").alias("most_files"), F.max("lines").alias("most_lines"))
