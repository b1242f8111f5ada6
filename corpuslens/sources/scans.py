"""Scans: repositories, logs, manifests, notes, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators.files import apply_ignore
from ..tables import folders

MANIFESTS = r"(^|/)(package\.json|composer\.json|go\.mod|Cargo\.toml|Gemfile|requirements\.txt|pyproject\.toml|setup\.py|setup\.cfg|pom\.xml|build\.gradle(\.kts)?)\z"
#: Fixed value: the folder of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
DAY_FILE = r"^(\d{4}-\d{2}-\d{2})\.md\z"


def readable(size: Column, content: Column, max_bytes: int = 2_000_000) -> Column:
    """Small enough, and no NUL among the first 8,192 bytes."""
    return (size <= max_bytes) & ~F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def scan_corpus(spark: SparkSession, root: str, max_bytes: int = 2_000_000) -> DataFrame:
    """repo_id, path, bytes, lines, text of every readable file of root/<repo_id>/…"""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") <= max_bytes)
    inner = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    text = F.decode("content", "UTF-8")
    rows = raw.where(readable(F.col("length"), F.col("content"), max_bytes)).select(inner.alias("inner"), F.col("length").alias("bytes"), text.alias("text"))
    return rows.select(
        F.substring_index("inner", "/", 1).alias("repo_id"),
        F.expr("substring(inner, instr(inner, '/') + 1)").alias("path"),
        "bytes",
        C.line_count("text").cast("int").alias("lines"),
        "text",
    )


def describe_files(file_text: DataFrame) -> DataFrame:
    """The files table: what paths tell, without the text."""
    lang = C.detect_language("path")
    return file_text.select(
        "repo_id", "path", lang.alias("lang"), C.category_of(lang).alias("category"), "lines", "bytes", C.is_test_path("path").alias("is_test"), C.is_entry_path("path").alias("is_entry")
    )


def read_tracked(spark: SparkSession, path: str) -> DataFrame:
    """Paths from NUL-separated listings named <repo_id>.tracked."""
    raw = spark.read.option("lineSep", "\0").text(path).withColumn("repo_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.tracked", 1))
    return raw.where("value != ''").select("repo_id", F.col("value").alias("path")).dropDuplicates()


def _log_lines(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """repo_id, value, at: the lines of <repo_id>.<ending> files, and their order, without reading a file whole."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("at"))
    return raw.select(F.regexp_extract("file", rf"([^/]+)\.{ending}$", 1).alias("repo_id"), "value", "at")


def read_touches(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """repo_id, sha, ts, path from change logs: ``@sha epoch`` headers, each followed by its paths.

    A line belongs to the last header before it.
    """
    header = r"^@(\S+) (\d+)\s*$"
    lines = _log_lines(spark, path, "log")
    head = F.when(F.col("value").rlike(header), F.struct(F.regexp_extract("value", header, 1).alias("sha"), F.timestamp_seconds(F.regexp_extract("value", header, 2).cast("long")).alias("ts")))
    own = F.last("head", ignorenulls=True).over(Window.partitionBy("repo_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("head", head).withColumn("own", own).where("head is null and own is not null and value != ''")
    rows = rows.select("repo_id", "own.sha", "own.ts", F.col("value").alias("path"))
    return rows if since is None else rows.where(F.col("ts") >= since)


def read_renames(spark: SparkSession, path: str) -> DataFrame:
    """repo_id, seq, old_path, new_path; seq rises with age, the log being newest first."""
    lines = _log_lines(spark, path, "renames").where(F.col("value").rlike(r"^R\d*\t"))
    parts = F.split("value", "\t")
    seq = F.row_number().over(Window.partitionBy("repo_id").orderBy("at")).cast("long")
    return lines.select("repo_id", seq.alias("seq"), F.get(parts, F.lit(1)).alias("old_path"), F.get(parts, F.lit(2)).alias("new_path"))


def read_manifests(file_text: DataFrame) -> DataFrame:
    """Manifests with their parsed form; a malformed one has null there and costs only itself."""
    return file_text.where(F.col("path").rlike(MANIFESTS)).select("repo_id", "path", "text", F.when(F.col("path").endswith(".json"), F.try_parse_json("text")).alias("parsed"))


def scan_notes(file_text: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Markdown notes that no ignore pattern drops, with label, layer and body; file_text has vault_id, path, text."""
    notes = file_text.where(F.col("path").rlike(r"(?i)\.md\z"))
    notes = apply_ignore(notes, patterns) if patterns is not None else notes
    return notes.select("*", C.note_id(C.basename("path")).alias("note_id"), C.note_label("text", "path").alias("label"), C.vault_layer("path").alias("layer"), C.note_body("text").alias("body"))


def list_projects(notes: DataFrame) -> DataFrame:
    """Entries under projects/: a note or a folder of notes each; dot folders are none."""
    entry = F.regexp_extract("path", r"^projects/([^/]+)", 1)
    found = notes.withColumn("entry", entry).where("entry != '' and not startswith(entry, '.')")
    return found.select("vault_id", F.regexp_replace("entry", r"\.md\z", "").alias("slug")).distinct()


def project_context(notes: DataFrame, slug: str) -> DataFrame:
    """A project's notes joined in the order of their names."""
    own = notes.where((F.col("path") == f"projects/{slug}.md") | F.col("path").startswith(f"projects/{slug}/"))
    return own.groupBy("vault_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("context"))


def recent_memory(memory: DataFrame, days: int = 7) -> DataFrame:
    """Entries of the last so many days that exist, newest day first."""
    ranked = memory.select("repo_id", "day").distinct().withColumn("age", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("day")))).where(F.col("age") <= days)
    return memory.join(ranked, ["repo_id", "day"])


def scan_recent_memory(spark: SparkSession, path: str, days: int = 7) -> DataFrame:
    """Entries of the last so many days that each repository has, from what ``sinks.append_memory`` wrote; older days' files aren't opened.

    The days are the names of folders, which Spark lists anyway before it reads a table.
    """
    held: dict[str, dict[str, list[str]]] = {}
    for folder in folders(spark, f"{path}/batch=*/repo=*/day=*"):
        _, repo, day = (x.split("=", 1)[1] for x in folder.split("/")[-3:])
        held.setdefault(repo, {}).setdefault(day, []).append(folder)
    kept = [x for own in held.values() for day in sorted((d for d in own if d != NO_DAY), reverse=True)[:days] for x in own[day]]
    return spark.read.option("basePath", path).parquet(*kept)


def memory_from_files(file_text: DataFrame) -> DataFrame:
    """Entries of day files: ``## HH:MM · kind`` headings and what follows."""
    day = F.to_date(F.regexp_extract(C.basename("path"), DAY_FILE, 1))
    entries = F.regexp_extract_all("text", F.lit(r"(?s)(?:^|\n)(## \d{2}:\d{2} · .*?)(?=\n## \d{2}:\d{2} · |\z)"), F.lit(1))
    rows = file_text.where(C.basename("path").rlike(DAY_FILE)).select("repo_id", day.alias("day"), F.explode(entries).alias("entry"))
    at = F.regexp_extract("entry", r"^## (\d{2}:\d{2}) · ([^\n]*)", 1)
    body = F.regexp_replace("entry", r"^## [^\n]*\s*|\s+\z", "")
    return rows.select("repo_id", "day", F.to_timestamp(F.concat_ws(" ", "day", at)).alias("ts"), F.regexp_extract("entry", r"^## \d{2}:\d{2} · ([^\n]*)", 1).alias("kind"), body.alias("body"))


def context_docs(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(rules.CONTEXT_DOC))


def read_enrichment(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and issues of batch results (repo_id, batch_no, text): a JSON list, or an object with a list as files.

    A field of another type than it should have is null, a tag that is no string is left out. An answer
    without entries is one row without a pos, so that it counts as an answer. Text that isn't JSON, and
    JSON of another shape, are an issue each.
    """
    list_ = "array<variant>"
    parsed = raw.withColumn("v", F.try_parse_json("text")).withColumn("entries", F.coalesce(F.try_variant_get("v", "$", list_), F.try_variant_get("v", "$.files", list_)))
    wrong = F.when(F.col("v").isNull(), "invalid json").when(F.col("entries").isNull(), "no list of entries")
    bad = parsed.select("repo_id", "batch_no", wrong.alias("issue")).where("issue is not null")
    is_text = lambda x: F.schema_of_variant(x) == "STRING"

    def field(name: str) -> Column:
        x = F.try_variant_get("entry", f"$.{name}", "variant")
        return F.when(is_text(x), F.try_variant_get("entry", f"$.{name}", "string")).alias(name)

    tags = F.transform(F.filter(F.try_variant_get("entry", "$.tags", list_), is_text), lambda x: F.try_variant_get(x, "$", "string"))
    rows = parsed.where("entries is not null").select("repo_id", "batch_no", F.posexplode_outer("entries").alias("pos", "entry"))
    return rows.select("repo_id", "batch_no", "pos", field("path"), field("summary"), field("role"), tags.alias("tags")), bad
