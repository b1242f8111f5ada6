"""Secret scan and the gate that refuses what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules


def _hits(text: Column, kind: str, words: list[str], pattern: str) -> Column:
    """Matches of one rule as an array of (kind, line, match); the pattern runs only where a word of it occurs.

    Texts are matched whole, since a match may span lines. Its line is 1 and the newlines in all that
    lies before it: the pieces between matches and the matches themselves.
    """
    none = F.array().cast("array<struct<kind:string,line:int,match:string>>")
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def lines(matches: Column) -> Column:
        return C.let(
            F.split(text, pattern, -1),
            lambda pieces: F.transform(
                matches,
                lambda m, k: F.struct(
                    F.lit(kind).alias("kind"),
                    (F.aggregate(F.slice(pieces, F.lit(1), k + 1), F.lit(1), lambda a, x: a + newlines(x)) + F.aggregate(F.slice(matches, F.lit(1), k), F.lit(0), lambda a, x: a + newlines(x))).cast("int").alias("line"),
                    m.alias("match"),
                ),
            ),
        )

    low = F.lower(text)
    tried = F.lit(False)
    for w in words:
        tried = tried | F.contains(low, F.lit(w))
    return F.when(tried, C.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lines)).otherwise(none)


def found_secrets(text: Column | str) -> Column:
    """Matches of every rule but placeholders, as an array of (kind, line, match); unredacted, for use inside a job only."""
    own = F.coalesce(C.col(text), F.lit(""))
    words = F.array(*map(F.lit, dict.fromkeys(w for _, words, _ in rules.SECRETS for w in words)))
    worth = C.let(F.lower(own), lambda low: F.exists(words, lambda w: F.contains(low, w)))  # few texts are, and only they are tried rule by rule
    every = F.filter(F.concat(*[_hits(own, *rule) for rule in rules.SECRETS]), lambda x: ~C.is_placeholder(x["match"]))
    return F.when(worth, every).otherwise(F.array().cast("array<struct<kind:string,line:int,match:string>>"))


def secret_kinds(text: Column | str) -> Column:
    """The kinds of secret in a text, sorted, each once, and never a value."""
    return F.array_sort(F.array_distinct(F.transform(found_secrets(text), lambda x: x["kind"])))


def secret_matches(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """keys, kind, line, match of every rule; unredacted, for use inside a job only."""
    rows = docs.select(*keys, F.explode(found_secrets(text_col)).alias("x"))
    return rows.select(*keys, "x.kind", "x.line", "x.match")


def scan_secrets(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """keys, kind, line, match_redacted: a value is never shown."""
    return secret_matches(docs, text_col, keys).select(*keys, "kind", "line", C.redact("match").alias("match_redacted"))


def scan_scope(file_text: DataFrame, max_bytes: int = 400_000) -> DataFrame:
    """Files that the scan reads, and whether they are exempt."""
    scope = file_text.where((C.category_of(C.detect_language("path")) != "docs") & (F.octet_length("text") <= max_bytes))
    return scope.withColumn("exempt", F.contains("text", F.lit(rules.EXEMPTION)))


def gate(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, is_clean, kinds (sorted, never a value) for every row."""
    return df.select(*keys, secret_kinds(text_col).alias("kinds")).select(*keys, (F.size("kinds") == 0).alias("is_clean"), "kinds")


def leaky_files(file_text: DataFrame, max_bytes: int = 400_000) -> DataFrame:
    """repo_id, path, hits, kinds (of each hit, in order of the rules), exempt, fixture of the files in scope that hold a secret."""
    scope = scan_scope(file_text, max_bytes).select("repo_id", "path", found_secrets("text").alias("found"), "exempt")
    kinds = F.transform("found", lambda x: x["kind"])
    return scope.where(F.size("found") > 0).select("repo_id", "path", F.size("found").alias("hits"), kinds.alias("kinds"), "exempt", C.is_fixture_path("path").alias("fixture"))


def secret_findings(leaky: DataFrame, evidence: int = 20) -> DataFrame:
    """repo_id, kind, severity, hits, files, evidence, targets of leaky_files.

    Critical, counting the files outside fixtures, if there are any; else medium, counting all. All
    paths are targets, the first so many evidence, with the kind of every hit. Exempt files are one low finding of their own.
    """
    open_ = leaky.where("not exempt")
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))  # so many of a group leave each task
    said = F.struct("rank", F.concat_ws(": ", "path", F.array_join("kinds", ", ")).alias("said"))
    first = open_.withColumn("rank", rank).where(F.col("rank") <= evidence).groupBy("repo_id").agg(F.array_sort(F.collect_list(said)).alias("first"))
    rolled = open_.groupBy("repo_id").agg(
        F.sum("hits").alias("all_hits"),
        F.count(F.lit(1)).alias("all_files"),
        F.sum(F.when(~F.col("fixture"), F.col("hits"))).alias("real_hits"),
        F.count_if(~F.col("fixture")).alias("real_files"),
        F.array_sort(F.collect_list("path")).alias("targets"),
    )
    rolled = rolled.join(first, "repo_id").withColumn("evidence", F.transform("first", lambda x: x["said"]))
    real = F.col("real_files") > 0
    pick = lambda c: F.when(real, F.col(f"real_{c}")).otherwise(F.col(f"all_{c}")).alias(c)
    out = rolled.select("repo_id", F.lit("secrets").alias("kind"), F.when(real, "critical").otherwise("medium").alias("severity"), pick("hits"), pick("files"), "evidence", "targets")
    none = F.array().cast("array<string>")
    low = leaky.where("exempt").groupBy("repo_id").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("files"))
    return out.unionByName(low.select("repo_id", F.lit("secrets-exempt").alias("kind"), F.lit("low").alias("severity"), "hits", "files", none.alias("evidence"), none.alias("targets")))


def firewall_hits(notes: DataFrame, terms: list[str]) -> DataFrame:
    """Lines that hold a listed term, whatever its case."""
    lines = notes.select("vault_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("n", "said"))
    found = F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower("said"), t))
    return lines.select("vault_id", "path", (F.col("n") + 1).alias("line"), F.explode(found).alias("term"))
