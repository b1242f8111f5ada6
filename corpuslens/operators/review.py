"""Documents against the files they speak of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..tables import broadcast_if_small, settle, tasks_for
from .graph import follow_renames


def lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each line, numbered from 1."""
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "text_line")).select(*keep, (F.col("n") + 1).alias("line"), "text_line")


def ancestors(f: DataFrame) -> DataFrame:
    return f.select("repo_id", F.explode(C.ancestors("path")).alias("dir")).distinct()


def governing_docs(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """repo_id, path, doc, nearness: briefs in a changed path's directory or above, nearest first; shims are none."""
    up = F.array_append(C.ancestors("path"), F.lit(""))
    places = changed.select("repo_id", "path", F.explode(up).alias("dir"))
    briefs = docs.where(F.col("path").rlike(rules.BRIEF) & ~C.is_shim("text")).select("repo_id", F.col("path").alias("doc"), C.dir_of("path").alias("dir"))
    briefs = broadcast_if_small(settle(briefs, "briefs"))  # the paths of one directory must not meet in one task
    found = places.join(briefs, ["repo_id", "dir"]).repartition(tasks_for(changed.sparkSession, changed.count()), "repo_id", "path")
    order = Window.partitionBy("repo_id", "path").orderBy(F.desc(F.length("dir")), "doc")
    return found.select("repo_id", "path", "doc", F.row_number().over(order).alias("nearness"))


def brief_coverage(governing: DataFrame) -> DataFrame:
    """repo_id, doc, dir, covers: each brief with the changed paths it governs."""
    own = governing.groupBy("repo_id", "doc").agg(F.array_sort(F.collect_set("path")).alias("covers"))
    return own.select("repo_id", "doc", C.dir_of("doc").alias("dir"), "covers")


def holding(rows: DataFrame, text: str, needles: DataFrame) -> DataFrame:
    """rows(repo_id, …), once with each of needles(repo_id, needle) that the column text contains.

    Any character may stand in a needle, so it is filed under one run of its characters (8 long, 3 if it
    is shorter, or 1): of its own runs the one that the fewest needles of its repository have. Texts give
    out only runs under which some needle is filed, before anything is shuffled, and a needle that a
    text's run leads to is then looked for in the text itself.
    """

    def runs(c: str) -> Column:
        return F.when(F.length(c) >= 8, C.grams(c, 8)).when(F.length(c) >= 3, C.grams(c, 3)).otherwise(C.grams(c, 1))

    own = settle(needles.select("repo_id", "needle").distinct().withColumn("gram", F.explode(F.array_distinct(runs("needle")))), "needle-runs")
    common = own.groupBy("repo_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    filed = own.join(common, ["repo_id", "gram"]).groupBy("repo_id", "needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    filed = settle(filed, "needles")
    used = broadcast_if_small(settle(filed.select("gram").distinct(), "needle-grams"))
    every = F.array_distinct(F.concat(*[C.grams(text, n) for n in (8, 3, 1)]))
    given = rows.withColumn("gram", F.explode(every)).join(used, "gram", "left_semi")
    return given.join(broadcast_if_small(filed), ["repo_id", "gram"]).where(F.contains(text, F.col("needle"))).drop("gram")


def stale_mentions(changed: DataFrame, docs: DataFrame, files: DataFrame, keep: int = 12) -> DataFrame:
    """repo_id, doc, line, names, text, total: lines of unchanged context documents that name a changed file.

    A file is named by its path, if it lies in a directory, or by a long name that no other file has. A
    line and a path count once; of each document the first ``keep`` pairs stay, total counts all.
    """
    unique = files.groupBy("repo_id", C.basename("path").alias("needle")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where((F.col("n") == 1) & (F.length("needle") > 6))
    known = changed.select("repo_id", "path").distinct()
    by_name = unique.join(known, ["repo_id", "path"], "left_semi").select("repo_id", "needle", "path")
    by_path = known.where(F.contains("path", F.lit("/"))).select("repo_id", F.col("path").alias("needle"), "path")
    needles = settle(by_path.unionByName(by_name).distinct(), "mentioned")
    own = docs.where(F.col("path").rlike(rules.CONTEXT_DOC)).join(known, ["repo_id", "path"], "left_anti").select("repo_id", F.col("path").alias("doc"), "text")
    said = holding(lines(own).where("text_line != ''").select("repo_id", "doc", "line", "text_line"), "text_line", needles)
    hits = said.join(needles, ["repo_id", "needle"]).select("repo_id", "doc", "line", F.col("path").alias("names"), "text_line").distinct()
    per_doc = Window.partitionBy("repo_id", "doc")
    ranked = hits.withColumn("total", F.count(F.lit(1)).over(per_doc)).withColumn("rank", F.row_number().over(per_doc.orderBy("line", "names")))
    return ranked.where(F.col("rank") <= keep).select("repo_id", "doc", "line", "names", C.excerpt("text_line").alias("text"), "total")


def glossary_terms(docs: DataFrame) -> DataFrame:
    """Headings of each repository's first CONTEXT.md."""
    own = docs.where(F.col("path").rlike(rules.GLOSSARY)).groupBy("repo_id").agg(F.min_by("text", "path").alias("text"))
    terms = own.select("repo_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^#{2,4}[ \t]+([^\n]+)"), F.lit(1))).alias("term"))
    return terms.withColumn("needle", C.glossary_needle("term")).where("needle is not null and needle != ''")


def glossary_hits(changed: DataFrame, terms: DataFrame) -> DataFrame:
    terms = settle(terms.select("repo_id", "term", "needle").distinct(), "terms")
    said = holding(changed.select("repo_id", "path").distinct().withColumn("lowered", F.lower("path")), "lowered", terms)
    return said.join(terms, ["repo_id", "needle"]).select("repo_id", "path", "term").distinct()


def extract_citations(docs: DataFrame) -> DataFrame:
    """repo_id, doc, line, text_line, cited: backticked tokens, then link targets, once a line."""
    code = F.regexp_extract_all("text_line", F.lit(r"`([A-Za-z0-9_./-]+)`"), F.lit(1))
    links = F.regexp_extract_all("text_line", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
    clean = F.array_distinct(F.transform(F.concat(code, links), lambda c: F.regexp_replace(c, r"^\./", "")))
    rows = lines(docs.select("repo_id", F.col("path").alias("doc"), "text"))
    return rows.select("repo_id", "doc", "line", "text_line", F.explode(clean).alias("cited")).where(C.is_path_citation("cited"))


def citation_drift(docs: DataFrame, files: DataFrame, renames: DataFrame) -> DataFrame:
    """repo_id, doc, line, text, cited, class, suggestion: citations that no file or directory answers.

    Looked up from the document's directory, with ``..`` taken out, then as written from the root.
    Context documents speak, but for those under templates/. A suspected citation whose path was
    renamed to one that exists is provable, with the new path as suggestion.
    """
    known = files.select("repo_id", F.col("path").alias("target")).unionByName(ancestors(files).withColumnRenamed("dir", "target")).distinct()
    cited = extract_citations(docs.where(F.col("path").rlike(rules.CONTEXT_DOC) & ~F.col("path").startswith("templates/")))
    cited = cited.withColumn("near", C.normalize_path(C.dir_of("doc"), "cited")).withColumn("root", F.col("cited"))
    open_ = cited
    for place in ("near", "root"):
        open_ = open_.join(known.withColumnRenamed("target", place), ["repo_id", place], "left_anti")
    final = follow_renames(renames)
    landed = final.join(known, (final["repo_id"] == known["repo_id"]) & (final["final_path"] == known["target"]), "left_semi")
    hops = landed.select("repo_id", F.col("old_path").alias("cited"), F.col("final_path").alias("to"))
    joined = open_.join(hops, ["repo_id", "cited"], "left")
    kind = C.citation_class("doc", "text_line")
    proven = (kind == "suspected") & F.col("to").isNotNull()
    return joined.select("repo_id", "doc", "line", C.excerpt("text_line").alias("text"), "cited", F.when(proven, "provable").otherwise(kind).alias("class"), F.when(proven, F.col("to")).alias("suggestion"))


def drift_counts(drift: DataFrame) -> DataFrame:
    """Counts by class, and whether anything provable should stop a change."""
    counts = drift.groupBy("repo_id").agg(*[F.count_if(F.col("class") == k).alias(k) for k in ("provable", "suspected", "historical")])
    return counts.withColumn("gate", F.col("provable") > 0)


def citation_patch(drift: DataFrame, docs: DataFrame) -> DataFrame:
    """repo_id, doc, patch: hunks that replace the cited tokens of provable rows, all fixes of a line in one."""
    fixes = drift.where(F.col("class") == "provable").groupBy("repo_id", "doc", "line").agg(F.array_sort(F.collect_set(F.struct("cited", "suggestion"))).alias("fixes"))
    rows = lines(docs.select("repo_id", F.col("path").alias("doc"), "text")).join(fixes, ["repo_id", "doc", "line"])
    after = F.aggregate("fixes", F.col("text_line"), lambda acc, f: F.replace(acc, f["cited"], f["suggestion"]))
    hunk = F.concat_ws("\n", F.format_string("@@ -%d,1 +%d,1 @@", "line", "line"), F.concat(F.lit("-"), "text_line"), F.concat(F.lit("+"), after))
    hunks = rows.groupBy("repo_id", "doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", hunk.alias("hunk")))), lambda h: h["hunk"]), "\n").alias("hunks"))
    return hunks.select("repo_id", "doc", F.concat(F.lit("--- a/"), "doc", F.lit("\n+++ b/"), "doc", F.lit("\n"), "hunks", F.lit("\n")).alias("patch"))


def union_changes(*changes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select("repo_id", "path") for c in changes]).withColumn("path", C.clean_input_path("path")).distinct()


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, state of directories of two trees (name, path, digest): missing, differing or only in the mirror."""
    roll = lambda t, c: t.groupBy("name").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("path", "digest")))).alias(c))
    both = roll(a, "ha").join(roll(b, "hb"), "name", "full")
    state = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "mirror-only").when(F.col("ha") != F.col("hb"), "differing")
    return both.select("name", state.alias("state")).where("state is not null")


def value_drift(sites: DataFrame, canonical: DataFrame) -> DataFrame:
    """fact, site, problem: declared values that differ from the canonical one, or facts without one."""
    joined = sites.join(canonical.select("fact", F.col("value").alias("canonical")), "fact", "left")
    problem = F.when(F.col("canonical").isNull(), "unknown fact").when(F.col("value").isNull(), "missing").when(F.col("value") != F.col("canonical"), "drift")
    return joined.select("fact", "site", problem.alias("problem")).where("problem is not null")


def dangling_refs(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Names that documents mention as `/name` and that don't exist."""
    said = docs.select("repo_id", F.col("path").alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("`/([a-z][a-z0-9-]*)`"), F.lit(1)))).alias("name"))
    return said.join(names.select("name"), "name", "left_anti")


def unlisted(names: DataFrame, docs: DataFrame) -> DataFrame:
    said = docs.select(F.explode(F.regexp_extract_all("text", F.lit("`/?([a-z][a-z0-9-]*)`"), F.lit(1))).alias("name")).distinct()
    return names.join(said, "name", "left_anti")
