"""Stacks from manifests, and the skills they call for."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules


def names_dependency(text: Column, path: Column, dep: str) -> Column:
    """A JSON manifest has the dependency as a key; others as a token of its own."""
    quoted = re.sub(r"([\\.^$|()\[\]{}+?*/@-])", r"\\\1", dep)
    return F.when(path.endswith(".json"), text.rlike(rf'"{quoted}"\s*:')).otherwise(text.rlike(rf"(?i)(^|[^A-Za-z0-9_-]){quoted}([^A-Za-z0-9_-]|\z)"))


def _proven(cases: list[tuple[str, Column]]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in cases])))


def detect_stack(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """repo_id, kind, signal_id, label of what manifests and files prove.

    All rules are expressions over a row, so a manifest or a file is read once and gives a row for each
    signal that it proves. A signal with both kinds of evidence needs both, unless its file is enough
    alone; one without dependencies needs its file only.
    """
    text, path = F.col("text"), F.col("path")
    by_manifest, by_file = [], []
    for name, _, _, deps, manifest, file, _ in rules.SIGNALS:
        if manifest is not None:
            hit = reduce(lambda a, b: a | b, [names_dependency(text, path, d) for d in deps]) if deps else F.lit(True)
            by_manifest.append((name, path.rlike(manifest) & hit))
        if file is not None:
            by_file.append((name, path.rlike(file)))
    said = manifests.select("repo_id", _proven(by_manifest).alias("signal_id"), F.lit("m").alias("how"))
    shown = files.select("repo_id", _proven(by_file).alias("signal_id"), F.lit("f").alias("how"))
    seen = said.unionByName(shown).groupBy("repo_id", "signal_id").agg(F.bool_or(F.col("how") == "m").alias("m"), F.bool_or(F.col("how") == "f").alias("f"))
    known = [(i, label, kind, bool(deps), manifest is not None, file is not None, alone) for i, label, kind, deps, manifest, file, alone in rules.SIGNALS]
    table = files.sparkSession.createDataFrame(known, "signal_id string, label string, kind string, has_deps boolean, by_manifest boolean, by_file boolean, alone boolean")
    both = F.when(F.col("has_deps"), F.col("m") & F.col("f")).otherwise(F.col("f"))
    needs = F.when(~F.col("by_file"), F.col("m")).when(~F.col("by_manifest"), F.col("f")).when(F.col("alone"), F.col("m") | F.col("f")).otherwise(both)
    return seen.join(F.broadcast(table), "signal_id").where(needs).select("repo_id", "kind", "signal_id", "label")  # a row for each rule


def stack_arrays(stack: DataFrame, stats: DataFrame) -> DataFrame:
    kinds = {"language": "languages", "framework": "frameworks", "data": "data", "service": "services", "test": "test", "delivery": "delivery"}
    own = stack.groupBy("repo_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("signal_id")))).alias(name) for k, name in kinds.items()])
    return own.join(stats.select("repo_id", "tests", "files"), "repo_id")


def register_rule(table: list[tuple], rule_id: str, rank: int, predicate_sql: str, title: str = "", why_sql: str = "''") -> list[tuple]:
    """A rule table with one more rule: when it holds and why, as SQL over the columns of stack_arrays."""
    return [*table, (rule_id, rank, predicate_sql, title, why_sql)]


def recommend(stack: DataFrame, stats: DataFrame, table: list[tuple] = rules.SKILLS) -> DataFrame:
    """repo_id, skill_id, rank, title, why; a repository without any stack gets none."""
    rows = stack_arrays(stack, stats)
    said = lambda i, r, title, why: F.struct(F.lit(i).alias("skill_id"), F.lit(r).alias("rank"), F.lit(title).alias("title"), F.expr(why).alias("why"))
    met = F.array_compact(F.array(*[F.when(F.expr(sql), said(i, r, title, why)) for i, r, sql, title, why in table]))
    return rows.select("repo_id", F.explode(met).alias("x")).select("repo_id", "x.*")


def partition_existing(proposed: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = existing.select("repo_id", "skill_id")
    return proposed.join(keys, ["repo_id", "skill_id"], "left_semi"), proposed.join(keys, ["repo_id", "skill_id"], "left_anti")


def primary_stack(manifests: DataFrame) -> DataFrame:
    """repo_id, label, language: the first framework of a fixed order that a root manifest shows."""
    at = lambda name: F.max(F.when(F.col("path") == name, F.col("text")))
    has = lambda name: F.bool_or(F.col("path") == name)
    m = manifests.groupBy("repo_id").agg(at("package.json").alias("pkg"), has("tsconfig.json").alias("ts"), has("pubspec.yaml").alias("dart"), F.bool_or(F.col("path").isin("requirements.txt", "pyproject.toml")).alias("py"), has("go.mod").alias("go"))
    order = {"next": "Next.js", "react-native": "React Native", "expo": "Expo", "@remix-run": "Remix", "vue": "Vue", "svelte": "Svelte", "express": "Express", "react": "React"}
    label = F.coalesce(*[F.when(F.contains("pkg", F.lit(f'"{k}' + ('"' if k[0] != "@" else ""))), F.lit(v)) for k, v in order.items()], F.when(F.col("pkg").isNotNull(), F.lit("Node")), F.when(F.col("dart"), F.lit("Flutter")), F.when(F.col("py"), F.lit("Python")), F.when(F.col("go"), F.lit("Go")), F.lit("—"))
    typed = F.col("ts") | F.contains("pkg", F.lit('"typescript"'))
    lang = F.when(F.col("pkg").isNotNull(), F.when(typed, "TypeScript").otherwise("JavaScript")).when(F.col("dart"), "Dart").when(F.col("py"), "Python").when(F.col("go"), "Go").otherwise("—")
    return m.select("repo_id", label.alias("label"), lang.alias("language"))


def package_manager(files: DataFrame) -> DataFrame:
    order = [("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("package-lock.json", "npm")]
    rank = F.coalesce(*[F.when(F.col("path") == p, i) for i, (p, _) in enumerate(order)])
    best = files.select("repo_id", rank.alias("i")).where("i is not null").groupBy("repo_id").agg(F.min("i").alias("i"))
    return best.select("repo_id", F.element_at(F.array(*[F.lit(m) for _, m in order]), F.col("i") + 1).alias("manager"))


def run_commands(manifests: DataFrame) -> DataFrame:
    """repo_id, script, command of root package.json scripts."""
    own = manifests.where("path = 'package.json' and parsed is not null")
    return own.select("repo_id", F.explode(F.try_variant_get("parsed", "$.scripts", "map<string,string>")).alias("script", "command"))


def purpose(readmes: DataFrame) -> DataFrame:
    """The first line of a README that is neither blank nor a heading."""
    body = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return readmes.select("repo_id", F.get(body, F.lit(0)).alias("purpose"))
