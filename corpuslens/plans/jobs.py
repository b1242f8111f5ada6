"""Whole jobs over a fleet of repositories: index, findings, report, review, impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import coverage, files, findings, graph, imports, review, secrets, stack
from ..sources import scans
from ..tables import settle, shuffled

#: From so many files on, descriptions of what files are for are worth their price.
ENRICH_FILES = 50
FINDING = ["repo_id", "seq", "severity", "kind", "title", "detail", "evidence", "action", "targets"]


def build_index(file_text: DataFrame, touches: DataFrame | None = None, tracked: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of an index from file_text(repo_id, path, text): what ``sinks.write_index`` writes.

    files (with commits, inbound, depth of code and scripts), edges, areas, layers, stack, stats,
    skipped. touches(repo_id, path, ts) gives commits; tracked(repo_id, path) tells which files of
    bin and obj count, without it none of them does.
    """
    none = file_text.select("repo_id", "path").limit(0)
    known = none if tracked is None else tracked
    kept = files.skip_ambiguous(files.skip_paths(file_text), known)
    kept = kept.withColumn("lines", C.line_count("text")).withColumn("bytes", F.octet_length("text"))
    described = scans.describe_files(kept)
    commits = None if touches is None else findings.hotspots(touches)
    described = described.withColumn("commits", F.lit(0).cast("long")) if commits is None else described.join(shuffled(commits), ["repo_id", "path"], "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    described = settle(described, "index-files")
    manifests = scans.read_manifests(kept)
    specs = settle(imports.extract_imports(kept), "index-specs")
    edges = settle(imports.build_edges(imports.resolve_imports(specs, described, manifests), described), "index-edges")
    code = described.where("category in ('code', 'script')").select("repo_id", "path")
    leveled = settle(graph.leveled(code, edges), "index-depth")
    table = graph.with_inbound(described, edges).join(shuffled(leveled), ["repo_id", "path"], "left")
    found = stack.detect_stack(described.select("repo_id", "path"), manifests)
    return {
        "files": settle(table, "index"),
        "edges": edges,
        "areas": findings.area_spans(described),
        "layers": graph.layers(leveled),
        "stack": found,
        "stats": findings.repo_stats(described),
        "skipped": files.skipped_by_guess(file_text, known),
    }


def test_coverage(index: dict[str, DataFrame], file_text: DataFrame) -> DataFrame:
    """repo_id, path, tests by the three signals: name, import and mention."""
    f = index["files"]
    tests = file_text.join(shuffled(f.where("is_test").select("repo_id", "path")), ["repo_id", "path"], "left_semi")
    return settle(coverage.coverage(coverage.coverage_name(f), coverage.coverage_import(f, index["edges"]), coverage.coverage_mention(f, tests)), "coverage")


def _finding(df: DataFrame, seq: int, severity: str | Column, kind: str, title: Column, detail: str, evidence: Column | None = None, action: str | None = None, targets: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    level = F.lit(severity) if isinstance(severity, str) else severity
    own = [F.lit(seq), level, F.lit(kind), title, F.lit(detail), none if evidence is None else evidence, F.lit(action).cast("string"), none if targets is None else targets]
    return df.select("repo_id", *[c.alias(name) for c, name in zip(own, FINDING[1:], strict=True)])


def _count(c: str, one: str, many: str) -> Column:
    return F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {one}").otherwise(f" {many}"))


def _listed(df: DataFrame, order: list[Column], said: Column, keep: int) -> DataFrame:
    """repo_id, n, evidence: how many rows a repository has, and the first so many in order."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    first = df.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))).alias("e"))
    return df.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).join(first, "repo_id").select("repo_id", "n", F.transform("e", lambda x: x["said"]).alias("evidence"))


def analyse(index: dict[str, DataFrame], file_text: DataFrame, present: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """repo_id, seq, severity, kind, title, detail, evidence, action, targets, rank: what each repository may improve.

    present(repo_id, path) are all paths there are, also those that the index skips, such as the
    tool's own directory. repos names repositories that may have no file at all; such a one has a
    single finding, that it is empty. seq is the order of the rules, rank the order of the report.
    """
    f, own = index["files"], present.select("repo_id", "path")
    every = (f if repos is None else repos.unionByName(f, allowMissingColumns=True)).select("repo_id").distinct()
    held = every.join(f.select("repo_id").distinct(), "repo_id", "left_semi")
    has = lambda name: held.join(own.where((F.col("path") == name) | F.col("path").startswith(f"{name}/")).select("repo_id"), "repo_id", "left_anti")
    out = [_finding(findings.greenfield(every, f), 0, "low", "greenfield", F.lit("Nothing to index yet"), "There is no source file: a context layer can be laid down now and grow with the code.")]
    bare = has("AGENTS.md").join(has("CLAUDE.md"), "repo_id", "left_semi")
    out.append(_finding(bare, 1, "high", "context", F.lit("No brief for agents"), "Neither AGENTS.md nor CLAUDE.md is at the root.", action="scaffold"))
    long = f.where("path = 'AGENTS.md' and lines > 250")
    out.append(_finding(long, 2, "medium", "context", F.concat(F.lit("AGENTS.md has "), F.col("lines").cast("string"), F.lit(" lines")), "It is loaded whole each time; parts about one area can move there.", action="brief"))
    out.append(_finding(has("CONTEXT.md"), 3, "medium", "context", F.lit("No glossary"), "CONTEXT.md would say what the terms of the domain mean.", action="scaffold"))
    out.append(_finding(has("docs/adr"), 4, "low", "context", F.lit("No decision records"), "docs/adr would keep decisions that were hard to reach.", action="scaffold"))
    leaky = settle(secrets.leaky_files(file_text.join(shuffled(f.select("repo_id", "path")), ["repo_id", "path"], "left_semi")), "leaky")
    hits = secrets.secret_findings(leaky)
    out.append(_finding(hits.where("kind = 'secrets-exempt'"), 5, "low", "security", F.concat(_count("files", "file", "files"), F.lit(" exempt from the secret scan")), "A marker in the file says that its secrets are examples."))
    title = F.when(F.col("severity") == "critical", F.concat(F.lit("Possible secrets in "), _count("files", "file", "files"))).otherwise(F.concat(F.lit("Secret-like strings in "), _count("files", "test file", "test files")))
    out.append(_finding(hits.where("kind = 'secrets'"), 6, F.col("severity"), "security", title, "Each is to be looked at; nothing is changed.", F.col("evidence"), "triage-secrets", F.col("targets")))
    counts = f.groupBy("repo_id").agg(F.count_if("is_test").alias("tests"), F.count_if(F.col("category") == "code").alias("code"), F.count(F.lit(1)).alias("n"))
    untried = counts.where("tests = 0 and code > 0")
    out.append(_finding(untried, 7, "high", "tests", F.lit("No test file"), "No path looks like a test, so no change is verified."))
    areas = coverage.untested_areas(f, test_coverage(index, file_text)).join(untried.select("repo_id"), "repo_id", "left_anti")
    said = F.format_string("%s - %d of %d untested, %d recent commits: %s", "dir", "untested", "code", "commits", F.replace("examples", F.lit(","), F.lit(", ")))
    open_ = _listed(areas, [F.desc("commits"), F.desc("untested"), F.col("dir")], said, 8).drop("n").join(coverage.untested_finding(areas), "repo_id")
    out.append(_finding(open_, 8, F.col("severity"), "tests", F.concat(_count("untested", "module", "modules"), F.lit(" without a test")), "No test has their name, imports or mentions them; the busiest areas come first.", F.col("evidence")))
    blind = findings.blind_languages(f.where("category = 'code'"), rules.BLIND_LANGUAGES)
    out.append(_finding(blind, 9, "low", "structure", F.concat(F.lit("Imports are not resolved for "), F.array_join("blind", ", ")), "Files of these languages have no edges because none can be read."))
    alone = _listed(graph.orphans(f, index["edges"], rules.BLIND_LANGUAGES), [F.col("path")], F.col("path"), 15)
    out.append(_finding(alone, 10, "low", "structure", F.concat(_count("n", "file is", "files are"), F.lit(" not referenced")), "Nothing imports them and they import nothing; they may still be loaded in other ways.", F.col("evidence")))
    line = lambda c, what: F.concat_ws(" - ", "path", F.concat(F.col(c).cast("string"), F.lit(f" {what}")))
    big = _listed(f.where("category = 'code' and lines > 600"), [F.desc("lines"), F.col("path")], line("lines", "lines"), 10)
    out.append(_finding(big, 11, "medium", "structure", F.concat(_count("n", "file", "files"), F.lit(" of over 600 lines")), "They may be split where there is a real seam.", F.col("evidence")))
    hot = _listed(findings.hot_files(f), [F.desc("commits"), F.col("path")], line("commits", "commits"), 10)
    out.append(_finding(hot, 12, "low", "structure", F.lit("Hot spots"), "The files that changed most of late.", F.col("evidence")))
    large = counts.where(F.col("n") >= ENRICH_FILES).join(own.where(F.col("path") == ".corpuslens/enriched.json").select("repo_id"), "repo_id", "left_anti")
    out.append(_finding(large, 13, "low", "enrichment", F.concat(_count("n", "file", "files"), F.lit(" without descriptions")), "Descriptions would let a search find files by what they are for.", action="enrich"))
    out.append(_finding(has(".corpuslens/memory"), 14, "low", "memory", F.lit("No shared memory"), "A committed memory lets people and agents share what they learned.", action="memory"))
    flags = findings.surface_flags(f).withColumn("tiers", F.array_compact(F.array(F.when(F.col("ui"), F.lit("browser")), F.when(F.col("api"), F.lit("api"))))).where("size(tiers) > 0")
    out.append(_finding(flags, 15, "low", "tooling", F.concat(F.lit("Tools that would be of use: "), F.array_join("tiers", ", ")), "The files show a use for them.", F.col("tiers"), "bundle", F.col("tiers")))
    briefs = findings.brief_candidates(f)
    order = [F.desc("score"), F.col("dir")]
    short = _listed(briefs, order, F.concat_ws(" - ", "dir", F.array_join("reasons", "; ")), 8)
    dirs = briefs.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "dir"))), lambda x: x["dir"]).alias("dirs"))
    out.append(_finding(short.join(dirs, "repo_id"), 16, "medium", "context", F.concat(_count("n", "area", "areas"), F.lit(" may deserve a brief")), "By size, churn and absence of tests.", F.col("evidence"), "brief", F.col("dirs")))
    return findings.rank_findings(reduce(DataFrame.unionByName, out))


def report(index: dict[str, DataFrame], found: DataFrame, repos: DataFrame, day: str) -> DataFrame:
    """repo_id, day, report_md: one report for each repository; see ``findings.render_reports``."""
    stats = repos.select("repo_id").distinct()
    edges = index["edges"].groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"))
    areas = index["areas"].groupBy("repo_id").agg(F.count(F.lit(1)).alias("areas"))
    top = findings.top_languages(index["files"]).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), "lang"))).alias("l"))
    top = top.select("repo_id", F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["lang"], (-x["n"]).cast("string"))), " · ").alias("top"))
    for df in (index["stats"].select("repo_id", "files", "lines", "tests"), edges, areas, top):
        stats = stats.join(df, "repo_id", "left")
    return findings.render_reports(found, stats.na.fill(0, ["files", "lines", "tests", "edges", "areas"]), day)


def review_change(index: dict[str, DataFrame], file_text: DataFrame, changed: DataFrame) -> dict[str, DataFrame]:
    """What speaks about changed(repo_id, path): known, unknown, briefs (with what they cover), glossary, decisions, stale."""
    known, unknown = files.split_known(changed, index["files"])
    known = settle(known, "changed")
    docs = settle(scans.context_docs(file_text.join(index["files"].select("repo_id", "path"), ["repo_id", "path"], "left_semi")), "context-docs")
    stale = settle(review.stale_mentions(known, docs, index["files"]), "stale")
    return {
        "known": known,
        "unknown": unknown,
        "briefs": review.brief_coverage(review.governing_docs(known, docs)),
        "glossary": review.glossary_hits(known, review.glossary_terms(docs)).select("repo_id", "term").distinct(),
        "decisions": stale.where(F.col("doc").rlike(rules.DECISION)).select("repo_id", "doc").distinct(),
        "stale": stale,
    }


def impact_report(index: dict[str, DataFrame], file_text: DataFrame, changed: DataFrame, max_depth: int | None = None) -> dict[str, DataFrame]:
    """What changed(query_id, repo_id, path) reaches: affected (hops, commits, tests, covered), unverified, tests to run, unknown, searches (truncated).

    changed may have a max_depth for each query_id; see ``graph.impact``.
    """
    f, cov = index["files"], test_coverage(index, file_text)
    known, unknown = files.split_known(changed, f)
    found, searches = graph.impact(index["edges"], known, max_depth)
    rows = graph.coverage_of(graph.order_impact(found, f), cov)
    affected = rows.select("query_id", "repo_id", "path", "hops", F.coalesce("is_test", F.lit(False)).alias("is_test"), F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("tests", F.array().cast("array<string>")).alias("tests"), F.col("tests").isNotNull().alias("covered"))
    return {"affected": affected, "unverified": graph.unverified(found, f, cov), "tests": graph.suggested_tests(found, known, f, cov), "unknown": unknown, "searches": searches}
