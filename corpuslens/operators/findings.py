"""Findings, the worklist they collapse to, and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules


def severity_rank(c: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, rules.SEVERITIES)), C.col(c))


def repo_stats(f: DataFrame) -> DataFrame:
    base = f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.count_if("is_test").alias("tests"))
    for name, by in (("languages", "lang"), ("categories", "category")):
        counts = f.groupBy("repo_id", by).agg(F.count(F.lit(1)).alias("n")).groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(name))
        base = base.join(counts, "repo_id", "left")
    return base


def language_categories(f: DataFrame) -> DataFrame:
    """repo_id, lang, category, level, files, lines: by both, by either and by neither.

    level tells them apart, since a language or category may itself be null: 0 both, 1 by language, 2 by
    category, 3 the whole repository.
    """
    sets = [[F.col(c) for c in by] for by in (("repo_id", "lang", "category"), ("repo_id", "lang"), ("repo_id", "category"), ("repo_id",))]
    level = F.grouping("lang") * 2 + F.grouping("category")
    return f.groupingSets(sets, "repo_id", "lang", "category").agg(level.cast("long").alias("level"), F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


def hotspots(touches: DataFrame, since: Column | None = None) -> DataFrame:
    rows = touches if since is None else touches.where(F.col("ts") >= since)
    return rows.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("commits"))


def areas(f: DataFrame) -> DataFrame:
    return f.groupBy("repo_id", C.area_key("path").alias("area")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def area_spans(f: DataFrame) -> DataFrame:
    """repo_id, area, files, first_path, last_path: areas without their paths in one row."""
    return f.groupBy("repo_id", C.area_key("path").alias("area")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def brief_candidates(f: DataFrame, min_files: int = 5) -> DataFrame:
    """Areas that deserve a brief of their own, by score; those that have one are left out.

    An area is a first directory, or two of them below a wrapper such as src; files at the root are in none.
    """
    rows = f.where(F.contains("path", F.lit("/"))).withColumn("dir", C.area_key("path"))
    briefed = f.where(C.basename("path") == "AGENTS.md").select("repo_id", C.dir_of("path").alias("dir")).distinct()
    sums = rows.groupBy("repo_id", "dir").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("category") == "code").alias("code"), F.count_if("is_test").alias("tests"), F.sum("lines").alias("lines"), F.sum("commits").alias("commits"))
    kept = sums.where(F.col("code") >= min_files).join(briefed, ["repo_id", "dir"], "left_anti")
    score = 2 * F.col("code") + 3 * F.col("commits") + F.when(F.col("tests") == 0, 10).otherwise(0) + F.floor(F.col("lines") / 500)
    said = lambda c, what: F.concat(F.col(c).cast("string"), F.lit(f" {what}"))
    size = F.when(F.col("code") >= 15, said("code", "code files, enough for a context of their own")).otherwise(said("code", "code files"))
    reasons = F.array_compact(F.array(size, F.when(F.col("tests") == 0, F.lit("no tests here")), F.when(F.col("commits") > 0, said("commits", "recent commits")), F.when(F.col("lines") > 3000, said("lines", "lines"))))
    return kept.withColumn("score", score.cast("long")).withColumn("reasons", reasons)


def order_briefs(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("score"), "dir")


def order_untested(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("commits"), F.desc("untested"))


def order_stale(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("total"), "path")


def cap_evidence(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("rank")


def hot_files(f: DataFrame, k: int = 10) -> DataFrame:
    own = f.where("category = 'code' and not is_test and commits > 0")
    return cap_evidence(own, ["repo_id"], [F.desc("commits"), F.col("path")], k)


def offers(findings: DataFrame) -> DataFrame:
    """One row for each repo_id and action of findings(repo_id, seq, severity, action, title, targets).

    The most severe member's severity; targets and titles once each, as first seen.
    """
    own = findings.where("action is not null")
    rolled = own.groupBy("repo_id", "action").agg(F.min(severity_rank("severity")).alias("sev"), F.array_sort(F.collect_list(F.struct("seq", "title", "targets"))).alias("m"))
    name = F.element_at(F.array(*map(F.lit, rules.SEVERITIES)), F.col("sev").cast("int"))
    return rolled.select("repo_id", "action", name.alias("severity"), F.array_distinct(F.flatten(F.transform("m", lambda x: x["targets"]))).alias("targets"), F.transform("m", lambda x: x["title"]).alias("titles"))


def rank_findings(findings: DataFrame) -> DataFrame:
    """rank within a repository: severity, kind, order of the rules."""
    order = Window.partitionBy("repo_id").orderBy(severity_rank("severity"), "kind", "seq")
    return findings.withColumn("rank", F.row_number().over(order))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").pivot("severity", rules.SEVERITIES).count().na.fill(0)


def union_findings(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def greenfield(repos: DataFrame, f: DataFrame) -> DataFrame:
    """A single low finding for repositories without files."""
    return repos.join(f.select("repo_id"), "repo_id", "left_anti").select("repo_id", F.lit("greenfield").alias("kind"), F.lit("low").alias("severity"))


def blind_languages(f: DataFrame, blind: list[str]) -> DataFrame:
    return f.where(F.col("lang").isin(blind)).groupBy("repo_id").agg(F.array_sort(F.collect_set("lang")).alias("blind"))


def surface_flags(f: DataFrame) -> DataFrame:
    ui = F.substring_index("path", ".", -1).isin(rules.UI_EXTENSIONS) | F.col("lang").isin(rules.UI_LANGUAGES)
    api = C.basename("path").rlike(rules.API_FILE)
    return f.groupBy("repo_id").agg(F.bool_or(ui).alias("ui"), F.bool_or(api).alias("api"))


def top_languages(f: DataFrame, k: int = 8) -> DataFrame:
    counts = f.groupBy("repo_id", "lang").agg(F.count(F.lit(1)).alias("files"))
    return cap_evidence(counts, ["repo_id"], [F.desc("files"), F.col("lang")], k)


def render_reports(findings: DataFrame, stats: DataFrame, day: str) -> DataFrame:
    """repo_id, day, report_md: one report for each row of stats(repo_id, files, lines, edges, tests, areas, top).

    A glance at the repository, its findings from critical to low with detail and evidence, and what
    happens next, which is another thing for a repository without files.
    """
    fence = "```"
    evidence = F.when(F.size("evidence") > 0, F.concat(F.lit(f"{fence}\n"), F.array_join("evidence", "\n"), F.lit(f"\n{fence}")))
    part = F.concat_ws("\n\n", F.concat(F.lit("#### "), F.col("title")), F.col("detail"), evidence)
    parts = findings.select("repo_id", F.struct(severity_rank("severity").alias("s"), "kind", "seq", part.alias("part")).alias("p"))
    sorted_ = parts.groupBy("repo_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    heading = [F.lit(f"### {x.capitalize()}") for x in rules.SEVERITIES]
    at = lambda k: F.transform(F.filter("p", lambda p: p["s"] == k), lambda p: p["part"])
    own = [at(k + 1) for k in range(len(heading))]
    body = F.concat_ws("\n\n", *[F.when(F.size(x) > 0, F.concat_ws("\n\n", h, F.array_join(x, "\n\n"))) for h, x in zip(heading, own, strict=True)])
    joined = stats.join(sorted_.select("repo_id", body.alias("body")), "repo_id", "left")
    said = lambda c, what: F.concat(F.lit("- "), F.format_number(F.col(c).cast("long"), 0), F.lit(f" {what}"))
    glance = F.concat_ws("\n", said("files", "files"), said("lines", "lines"), said("edges", "resolved imports"), said("tests", "test files"), F.concat(F.lit("- "), F.nullif("top", F.lit(""))), said("areas", "areas"))
    after = F.when(F.col("files") == 0, "Nothing, until someone says so. There is no code yet: lay down the context layer first.").otherwise("Nothing, until someone says which findings to act on.")
    text = F.concat_ws("\n\n", F.lit(f"# Findings {day}\n\nEach is a proposal; nothing was changed.\n\n## At a glance"), glance, F.lit("## Findings"), F.coalesce("body", F.lit("Nothing found.")), F.lit("## What happens next"), after)
    return joined.select("repo_id", F.lit(day).cast("date").alias("day"), text.alias("report_md"))
