"""File and note filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules


def _dirs(path: str = "path") -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def is_skipped(path: str = "path") -> Column:
    """In a directory of output or tools, or binary, locked or minified by name."""
    tail = F.lower(F.substring_index(path, ".", -1))
    named = F.col(path).rlike(r"(\.lock|-lock\.json|\.min\.js)\z")
    return F.arrays_overlap(_dirs(path), F.array(*map(F.lit, rules.SKIP_DIRS))) | tail.isin(rules.BINARY_EXTENSIONS) | named


def in_ambiguous_dir(path: str = "path") -> Column:
    return F.arrays_overlap(_dirs(path), F.array(*map(F.lit, rules.AMBIGUOUS_DIRS)))


def skip_paths(f: DataFrame) -> DataFrame:
    return f.where(~is_skipped())


def _guessed(f: DataFrame, tracked: DataFrame) -> DataFrame:
    return f.join(tracked.select("repo_id", "path").distinct().withColumn("is_tracked", F.lit(True)), ["repo_id", "path"], "left").withColumn("guessed", in_ambiguous_dir() & F.col("is_tracked").isNull()).drop("is_tracked")


def skip_ambiguous(f: DataFrame, tracked: DataFrame) -> DataFrame:
    """Without untracked files in bin or obj."""
    return _guessed(f, tracked).where("not guessed").drop("guessed")


def skipped_by_guess(f: DataFrame, tracked: DataFrame) -> DataFrame:
    """How many files each ambiguous directory cost that nothing else would have dropped."""
    lost = _guessed(f, tracked).where(F.col("guessed") & ~is_skipped())
    name = F.get(F.filter(_dirs(), lambda d: d.isin(rules.AMBIGUOUS_DIRS)), F.lit(0))
    return lost.groupBy("repo_id", name.alias("dir")).agg(F.count(F.lit(1)).alias("files"))


def ignore_regex(pattern: Column) -> Column:
    """``name/`` at any depth, ``*`` in the last segment, or an exact name at any depth."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"/\z", ""), r"([\\.^$|()\[\]{}+?])", r"\\$1")
    star = F.replace(quoted, F.lit("*"), F.lit("[^/]*"))
    return F.when(pattern.endswith("/"), F.concat(F.lit("(^|/)"), quoted, F.lit("/"))).when(F.contains(pattern, F.lit("*")), F.concat(F.lit(r"(^|/)"), star, F.lit(r"\z"))).otherwise(F.concat(F.lit("(^|/)"), quoted, F.lit(r"(/|\z)")))


def apply_ignore(notes: DataFrame, patterns: DataFrame) -> DataFrame:
    """notes(vault_id, path, …) without what patterns(vault_id, pattern) name.

    A vault without rows has the fallback list; comments and blanks are no patterns but make the list
    present. A vault's patterns become one expression, so the join is by vault and no pair of note
    and pattern is made.
    """
    lists = patterns.withColumn("p", F.trim("pattern")).withColumn("p", F.when((F.col("p") != "") & ~F.col("p").startswith("#"), F.col("p")))
    compiled = lists.groupBy("vault_id").agg(F.array_join(F.array_sort(F.collect_set(ignore_regex(F.col("p")))), "|").alias("own"))
    fallback = r"(^|/)(node_modules|\.git|archives)/|(^|/)README\.md\z"
    judged = notes.join(compiled, "vault_id", "left")
    dropped = F.when(F.col("own").isNull(), F.col("path").rlike(fallback)).when(F.col("own") == "", F.lit(False)).otherwise(F.expr("path rlike own"))
    return judged.where(~dropped & ~F.col("path").rlike(r"(^|/)(node_modules|\.git)/")).drop("own")


def firewall(projects: DataFrame, dirs: list[str]) -> DataFrame:
    """Projects outside the named work directories."""
    return projects.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, dirs))))


def firewall_purge(registered: DataFrame, projects: DataFrame, dirs: list[str]) -> DataFrame:
    """Registrations that a firewalled project left behind."""
    return registered.join(projects.where(F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, dirs)))).select("slug"), "slug", "left_semi")


def enrichable(f: DataFrame) -> DataFrame:
    return f.where("lines >= 3 and category != 'other'")


def in_project(notes: DataFrame, project: str) -> DataFrame:
    """Notes that lie in, or are, a file or folder of the project's name."""
    parts = F.transform(F.split(F.lower("path"), "/"), lambda x: F.regexp_replace(x, r"\.md\z", ""))
    return notes.where(F.array_contains(parts, project.lower()))


def oversize(f: DataFrame, lines: int = 600, agents_lines: int = 250, k: int = 10) -> DataFrame:
    """The k longest code files over the limit, and a root AGENTS.md over its own."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("lines"), "path"))
    code = f.where((F.col("category") == "code") & (F.col("lines") > lines)).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    return code.unionByName(f.where((F.col("path") == "AGENTS.md") & (F.col("lines") > agents_lines)))


def narrow_since(drift: DataFrame, touched: DataFrame) -> DataFrame:
    """Drift rows whose document, cited path or suggestion was touched."""
    named = F.explode(F.array_distinct(F.array_compact(F.array("doc", "cited", "suggestion"))))
    keys = drift.select("repo_id", "doc", "line", "cited", named.alias("path")).join(touched.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    return drift.join(keys.select("repo_id", "doc", "line", "cited").distinct(), ["repo_id", "doc", "line", "cited"], "left_semi")


def split_known(changed: DataFrame, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed paths in normal form: those of the index, and the rest."""
    clean = changed.withColumn("path", C.clean_input_path("path")).distinct()
    keys = f.select("repo_id", "path")
    return clean.join(keys, ["repo_id", "path"], "left_semi"), clean.join(keys, ["repo_id", "path"], "left_anti")


def digest_paths(touches: DataFrame) -> DataFrame:
    noise = F.col("path").rlike(r"\.bak|\.generated\.|digests/|audits/") | (F.trim("path") == "")
    return touches.where(~noise).select("repo_id", "path").distinct()


def missing_context(f: DataFrame, present: DataFrame, enrich_files: int = 50) -> DataFrame:
    """repo_id, kind, severity: a finding for each piece of context that a repository of f lacks.

    present(repo_id, path) are all paths there are: the tool's own directory is not among the indexed
    files f. Descriptions are asked for from enrich_files files on.
    """
    has = lambda pattern: F.coalesce(F.bool_or(F.col("path").rlike(pattern)), F.lit(False))
    seen = present.groupBy("repo_id").agg(has(r"^(AGENTS|CLAUDE)\.md\z").alias("brief"), has(r"^CONTEXT\.md\z").alias("glossary"), has(r"^docs/adr/").alias("decisions"), has(r"^\.corpuslens/memory(/|\z)").alias("memory"), has(r"^\.corpuslens/enriched\.json\z").alias("enriched"))
    counts = f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(seen, "repo_id", "left").withColumn("enriched", F.col("enriched") | (F.col("n") < enrich_files))
    kinds = {"brief": "high", "glossary": "medium", "decisions": "low", "memory": "low", "enriched": "low"}
    lost = F.array(*[F.when(~F.coalesce(F.col(k), F.lit(False)), F.struct(F.lit(f"missing-{k}").alias("kind"), F.lit(v).alias("severity"))) for k, v in kinds.items()])
    return rows.select("repo_id", F.explode(F.array_compact(lost)).alias("x")).select("repo_id", "x.*")


def malformed_notes(notes: DataFrame) -> DataFrame:
    """note and problem: no frontmatter, a project without a required key, a folder that contradicts its type."""
    is_project = F.col("path").startswith("projects/")
    missing = [F.when(is_project & C.fm_value("text", k).isNull(), F.lit(f"no {k}")) for k in ("path", "stack", "status", "title")]
    kind, folder = C.fm_value("text", "type"), F.substring_index("path", "/", 1)
    clash = F.when(kind.isNotNull() & F.contains(F.col("path"), F.lit("/")) & ~folder.isin("inbox") & ~folder.startswith(kind), F.lit("folder and type disagree"))
    none = ~F.col("text").rlike(r"^---[ \t]*\r?\n")
    problems = F.when(none, F.array(F.lit("no frontmatter"))).otherwise(F.array_compact(F.array(*missing, clash)))
    return notes.select("vault_id", "path", F.explode(problems).alias("problem"))


def absolute_paths(file_text: DataFrame) -> DataFrame:
    """Lines that hold a checkout path of one machine, outside history and tests."""
    lines = file_text.where(~C.is_test_path("path") & ~F.col("path").rlike(r"(^|/)(CHANGELOG\.md\z|docs/(adr|history)/)")).select("repo_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    found = lines.where(F.col("line").rlike(r"/(home|Users)/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+|[A-Z]:\\\\?[A-Za-z0-9_.-]+\\\\?[A-Za-z0-9_.-]+") & ~F.col("line").rlike(r"/(home|Users)/(you|user|name|me|x|<[^>]*>)/"))
    return found.select("repo_id", "path", (F.col("n") + 1).alias("line"), F.trim("line").alias("text"))
