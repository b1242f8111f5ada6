"""Note collections: links, search, projects, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..tables import broadcast_if_small, settle, tasks_for
from .files import in_project

#: So many characters of notes are one task's share where notes are searched.
TASK_CHARS = 2_000_000
#: What so many runs hold is found once and broadcast.
COMMON_RUNS = 100_000


def extract_wikilinks(notes: DataFrame) -> DataFrame:
    """vault_id, src, dst: distinct [[links]] outside fences, comments and inline code.

    Fence state is the running count of fence lines of a note, kept inside the row.
    """
    lines = F.split("text", "\n", -1)
    kept = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(x.rlike(r"^\s*```"), F.struct((~acc["inside"]).alias("inside"), acc["out"].alias("out")))
        .when(acc["inside"] | F.contains(x, F.lit("<!--")) | ~F.contains(x, F.lit("[[")), acc)
        .otherwise(F.struct(acc["inside"].alias("inside"), F.array_append(acc["out"], F.regexp_replace(x, "`[^`]*`", "")).alias("out"))),
        lambda acc: acc["out"],
    )
    targets = F.flatten(F.transform(kept, lambda x: F.regexp_extract_all(x, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))))
    rows = notes.select("vault_id", C.note_id(C.basename("path")).alias("src"), F.explode(targets).alias("target"))
    dst = C.note_id(F.regexp_replace("target", r"[|#](?s:.*)\z", ""))
    return rows.select("vault_id", "src", dst.alias("dst")).where("dst != '' and src != dst").distinct()


def link_gaps(notes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links whose target is no note, and notes without any link."""
    ids = notes.select("vault_id", "note_id").distinct()
    dead = links.join(ids.withColumnRenamed("note_id", "dst"), ["vault_id", "dst"], "left_anti")
    ends = links.select("vault_id", F.col("src").alias("note_id")).unionByName(links.select("vault_id", F.col("dst").alias("note_id")))
    return dead, ids.join(ends, ["vault_id", "note_id"], "left_anti")


def link_stats(notes: DataFrame, links: DataFrame) -> DataFrame:
    dead, alone = link_gaps(notes, links)
    count = lambda df, name: df.groupBy("vault_id").agg(F.count(F.lit(1)).alias(name))
    out = count(notes.select("vault_id", "note_id").distinct(), "notes")
    for df, name in ((links, "links"), (dead, "dead"), (alone, "orphans")):
        out = out.join(count(df, name), "vault_id", "left")
    return out.na.fill(0)


def remove_notes(notes: DataFrame, ids: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The notes that stay, their links to removed ones turned to plain text, and the archived ones.

    Those have archived_as, the name under which the archive keeps them, with the time of the removal.
    """
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyyMMdd-HHmmss")
    kept_as = F.concat(F.lit("archives/removed/"), F.regexp_replace(C.basename("path"), r"\.md\z", ""), F.lit("."), stamp, F.lit(".md"))
    gone = ids.select("vault_id", "note_id").distinct()
    archived = notes.join(gone, ["vault_id", "note_id"], "left_semi").withColumn("archived_as", kept_as)
    stay = notes.join(gone, ["vault_id", "note_id"], "left_anti")
    links = extract_wikilinks(stay).join(gone.withColumnRenamed("note_id", "dst"), ["vault_id", "dst"], "left_semi")
    named = links.groupBy("vault_id", F.col("src").alias("note_id")).agg(F.array_sort(F.collect_set("dst")).alias("lost"))
    joined = stay.join(named, ["vault_id", "note_id"], "left")

    def plain(text: Column, target: Column) -> Column:
        aliased = F.regexp_replace(text, F.concat(F.lit(r"\[\["), target, F.lit(r"(?:#[^\]|]*)?\|([^\]]+)\]\]")), F.lit("$1"))
        return F.regexp_replace(aliased, F.concat(F.lit(r"\[\[("), target, F.lit(r")(?:#[^\]]*)?\]\]")), F.lit("$1"))

    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.aggregate("lost", F.col("text"), plain))
    return joined.withColumn("text", text).drop("lost"), archived


def recall(notes: DataFrame, query: str, limit: int = 8, project: str | None = None) -> DataFrame:
    """The best notes for a query, of one project if it is named: occurrences of its tokens, then the newest, then the path."""
    terms = C.tokenize(F.lit(query))
    own = notes if project is None else in_project(notes, project)
    scored = own.withColumn("score", C.recall_score("text", terms)).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("mtime"), "path").limit(limit).select("vault_id", "path", "score", C.snippet("text", terms).alias("snippet"))


def _common_runs(notes: DataFrame, pieces: Column, terms: DataFrame) -> DataFrame:
    """run, hits (term, n): what the runs of most notes hold, so many as may be broadcast; other runs are looked up where they occur."""
    seen = notes.select(F.explode(F.array_distinct(C.tokenize("text"))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("notes"))
    seen = settle(seen.where("notes > 1").select("run", F.floor(F.log2("notes")).alias("level")), "runs")
    least, rows = 64, 0
    for level, n in sorted(seen.groupBy("level").count().collect(), reverse=True):  # a level for each power of two
        rows += n
        if rows > COMMON_RUNS:
            break
        least = level
    common = seen.where(F.col("level") >= least).select("run")
    held = common.withColumn("term", F.explode(pieces)).join(terms, "term").groupBy("run").agg(F.collect_list(F.struct("term", C.term_count(F.col("run"), F.col("term")).alias("n"))).alias("hits"))
    none = F.array().cast("array<struct<term:string,n:bigint>>")
    return F.broadcast(settle(common.join(held, "run", "left").select("run", F.coalesce("hits", none).alias("hits")), "common-runs"))


def recall_many(notes: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, path, score, rank for each of queries(query_id, query), a stated set.

    A term is letters and digits, so each of its occurrences lies inside one run of letters and digits
    of a text. The runs of a note are counted, cut into pieces as long as terms are and meet the terms,
    which go to all tasks if they are few; what the commonest runs hold is found once for all notes. Notes are dealt once, by their path, and all that follows
    from one stays with its task: neither runs, pieces nor scores are shuffled, only the best notes that
    a task has for a query. Work grows with the texts' distinct runs, not with texts times terms.
    """
    asked = queries.select("query_id", F.explode(C.tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = settle(asked, "asked")
    terms = settle(asked.select("term").distinct(), "terms")
    lengths = sorted(r[0] for r in terms.select(F.length("term")).distinct().collect())  # a few numbers
    own = notes.select("path", "mtime", "text")
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = own.repartition(tasks_for(notes.sparkSession, size, TASK_CHARS), "path")
    runs = dealt.select("path", "mtime", F.explode(C.tokenize("text")).alias("run")).groupBy("path", "mtime", "run").agg(F.count(F.lit(1)).alias("times_run"))
    pieces = F.array_distinct(F.flatten(F.array(*[C.grams("run", n) for n in lengths]))) if lengths else F.array().cast("array<string>")
    few = broadcast_if_small(terms)
    known = _common_runs(own, pieces, few)
    cut = runs.join(known, "run", "left").withColumn("hit", F.explode(F.coalesce("hits", F.transform(pieces, lambda t: F.struct(t.alias("term"), F.lit(None).cast("long").alias("n"))))))
    held = cut.select("path", "mtime", "run", "times_run", "hit.*").join(few, "term").withColumn("n", F.coalesce("n", C.term_count(F.col("run"), F.col("term"))))
    found = held.groupBy("path", "mtime", "term").agg(F.sum(F.col("n") * F.col("times_run")).alias("n"))
    scored = found.join(broadcast_if_small(asked), "term").groupBy("query_id", "path", "mtime").agg(F.sum(F.col("n") * F.col("times")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("mtime"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "path", "score", "rank")


def catch_up(notes: DataFrame, commits: DataFrame, project: str, since: Column) -> tuple[DataFrame, DataFrame]:
    """The 50 notes of a project that say most of it, and its commits since then."""
    return recall(notes, project, 50, project), commits.where((F.col("repo_id") == project) & (F.col("ts") >= since))


def digest(commits: DataFrame, since: Column, merged: DataFrame | None = None) -> DataFrame:
    """repo_id, digest: under a heading with the day, ``- sha subject (author, date)`` lines of commits since then, newest first, and of what was merged.

    merged(repo_id, number, title, ts) gives ``- #number title`` lines under a heading of their own,
    where there are any.
    """

    def block(rows: DataFrame, line: Column, name: str) -> DataFrame:
        own = rows.where(F.col("ts") >= since).select("repo_id", F.struct("ts", line.alias("line")).alias("x"))
        return own.groupBy("repo_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x"), asc=False), lambda x: x["line"]), "\n").alias(name))

    out = commits.select("repo_id").distinct()
    out = out.join(block(commits, F.format_string("- %s %s (%s, %s)", "sha", "subject", "author", C.day_stamp("ts")), "said"), "repo_id", "left")
    text = F.concat(F.lit("## Digest since "), C.day_stamp(since), F.lit("\n\n### Commits\n"), F.coalesce("said", F.lit("- (none)")))
    if merged is not None:
        out = out.join(block(merged, F.format_string("- #%s %s", F.col("number").cast("string"), "title"), "merged"), "repo_id", "left")
        text = F.concat_ws("\n\n", text, F.concat(F.lit("### Merged PRs\n"), F.col("merged")))
    return out.select("repo_id", F.concat(text, F.lit("\n")).alias("digest"))


def open_actions(notes: DataFrame) -> DataFrame:
    """Unchecked boxes under "Next actions", with their due dates."""
    section = F.regexp_extract("text", r"(?m)^#+ Next actions[^\n]*\n((?s:.*?))(?=^#|\z)", 1)
    boxes = F.regexp_extract_all(section, F.lit(r"(?m)^\s*- \[ \] ([^\n]+)"), F.lit(1))
    rows = notes.select("vault_id", "path", F.explode(boxes).alias("action"))
    return rows.withColumn("due", F.try_to_date(F.regexp_extract("action", r"(?:due|deadline):\s*(\d{4}-\d{2}-\d{2})", 1)))


def due_items(items: DataFrame, day: Column, ahead: int = 3) -> DataFrame:
    """Items (with a due date) that are over or due within so many days."""
    return items.where(F.col("due") <= F.date_add(day, ahead)).withColumn("overdue", F.col("due") < day)


def stale_notes(notes: DataFrame, day: Column, inbox_days: int = 14, daily_days: int = 90) -> DataFrame:
    """vault_id, reason, notes: inbox items that linger, finished projects, old daily notes."""
    age = C.age_days("mtime", day)
    reason = F.when(F.col("path").startswith("inbox/") & (age > inbox_days), "inbox").when(F.col("path").startswith("projects/") & C.fm_value("text", "status").isin("done", "dropped"), "finished").when(F.col("path").startswith("daily/") & (age > daily_days), "old daily")
    return notes.select("vault_id", reason.alias("reason")).where("reason is not null").groupBy("vault_id", "reason").agg(F.count(F.lit(1)).alias("notes"))


def moc_candidates(notes: DataFrame, least: int = 7) -> DataFrame:
    """Tags of so many notes without a map of content; notes have tags and type."""
    tagged = notes.select("vault_id", "type", F.explode("tags").alias("tag"))
    counts = tagged.groupBy("vault_id", "tag").agg(F.count(F.lit(1)).alias("notes"), F.bool_or(F.col("type") == "moc").alias("mapped"))
    return counts.where((F.col("notes") >= least) & ~F.coalesce("mapped", F.lit(False))).drop("mapped")


def frontmatter_summary(notes: DataFrame, key: str, section: str) -> DataFrame:
    """value, notes, with_section of a declared key; null stands for notes that don't declare it."""
    has = F.col("text").rlike(rf"(?m)^#+ {section}\s*$")
    return notes.groupBy(C.fm_value("text", key).alias("value")).agg(F.count(F.lit(1)).alias("notes"), F.count_if(has).alias("with_section"))


def undeclared(notes: DataFrame, key: str) -> DataFrame:
    """The notes that don't declare a key."""
    return notes.where(C.fm_value("text", key).isNull())


def context_footprint(f: DataFrame) -> DataFrame:
    """Bytes and tokens by load class."""
    return f.groupBy("repo_id", C.load_class("path").alias("load")).agg(F.sum("bytes").alias("bytes"), F.sum(C.est_tokens("bytes")).alias("tokens"))


def duplicates_exact(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Texts equal but for case and white space: the least id of each and how many share it."""
    normal = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+", " "))
    groups = docs.select(F.col(id_col).alias("id"), F.sha2(normal, 256).alias("digest")).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1").select("first", "copies")


def duplicate_blocks(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Paragraphs that stand in several documents: digest, documents, occurrences."""
    blocks = docs.select(F.col(id_col).alias("id"), F.explode(F.split(text_col, r"\n")).alias("block")).select("id", F.trim("block").alias("block")).where("block != ''")
    counts = blocks.groupBy(F.sha2("block", 256).alias("digest")).agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("id").alias("documents"))
    return counts.where("documents > 1")


def dedupe_repos(repos: DataFrame) -> DataFrame:
    """The first repository of each slug by path."""
    order = Window.partitionBy("slug").orderBy("path")
    return repos.withColumn("slug", C.slug("name")).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def registry_stats(projects: DataFrame) -> DataFrame:
    return projects.groupBy("status").agg(F.count(F.lit(1)).alias("projects"))


def registry_matrix(repos: DataFrame, notes: DataFrame) -> DataFrame:
    """Repositories by whether they have a brain and are registered."""
    known = notes.select("slug").distinct().withColumn("registered", F.lit(True))
    return repos.join(known, "slug", "full").select("slug", F.coalesce("has_brain", F.lit(False)).alias("has_brain"), F.coalesce("registered", F.lit(False)).alias("registered"))


def vault_score(notes: DataFrame, links: DataFrame, day: Column) -> DataFrame:
    """vault_id, capture, knowledge, context, cadence, total, stage, gaps (the three that cost most)."""
    age = C.age_days("mtime", day)
    under = lambda d: F.col("path").startswith(d + "/")
    linked = links.select("vault_id", F.col("src").alias("note_id")).distinct().withColumn("has_link", F.lit(True))
    n = notes.join(linked, ["vault_id", "note_id"], "left").groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("notes"),
        F.count_if("has_link").alias("linked"),
        F.count_if(under("inbox")).alias("inbox"),
        F.coalesce(F.bool_or(under("inbox") & (age <= 7)), F.lit(False)).alias("inbox_moves"),
        F.coalesce(F.bool_or(under("daily") & (age <= 7)), F.lit(False)).alias("daily"),
        F.coalesce(F.bool_or(C.fm_value("text", "type") == "moc"), F.lit(False)).alias("moc"),
        F.countDistinct(F.when(F.substring_index("path", "/", 1).isin("projects", "areas", "resources", "archives"), F.substring_index("path", "/", 1))).alias("para"),
        F.coalesce(F.bool_and(F.when(under("context"), F.length("text") > 200)), F.lit(False)).alias("filled"),
        F.coalesce(F.bool_or((F.col("path") == "context/current-focus.md") & (age < 14)), F.lit(False)).alias("focus"),
        F.coalesce(F.bool_or(F.col("path").rlike(r"^context/voice")), F.lit(False)).alias("voice"),
        F.coalesce(F.bool_or(under("decisions")), F.lit(False)).alias("decision"),
        F.coalesce(F.bool_or(age <= 7), F.lit(False)).alias("active"),
        F.coalesce(F.bool_or(under("templates")), F.lit(False)).alias("templates"),
    )
    points = {
        "capture": [("inbox used", 5, F.col("inbox") > 0, 3), ("daily notes", 10, F.col("daily"), 3), ("inbox flows", 10, (F.col("inbox") < 50) | F.col("inbox_moves"), 1)],
        "knowledge": [("five notes", 5, F.col("notes") >= 5, 1), ("half linked", 10, 2 * F.col("linked") > F.col("notes"), 2), ("a map", 5, F.col("moc"), 1), ("folders used", 5, F.col("para") >= 2, 1)],
        "context": [("context filled", 10, F.col("filled"), 3), ("focus fresh", 5, F.col("focus"), 1), ("voice", 5, F.col("voice"), 1), ("a decision", 5, F.col("decision"), 1)],
        "cadence": [("a ritual", 10, F.col("daily"), 2), ("active", 10, F.col("active"), 2), ("templates", 5, F.col("templates"), 1)],
    }
    scores = {k: sum(F.when(ok, p).otherwise(0) for _, p, ok, _ in v) for k, v in points.items()}
    total = sum(F.col(k) for k in points)
    lost = F.array_compact(F.array(*[F.when(~ok, F.struct(F.lit(-p * w).alias("cost"), F.lit(name).alias("name"))) for v in points.values() for name, p, ok, w in v]))
    gaps = F.transform(F.slice(F.array_sort(lost), 1, 3), lambda x: x["name"])
    out = n.select("vault_id", *[c.alias(k) for k, c in scores.items()], gaps.alias("gaps")).withColumn("total", total)
    stage = F.when(F.col("total") < 40, "Foundation").when(F.col("total") < 70, "Built").when(F.col("total") < 90, "Compounding").otherwise("Autonomous")
    return out.withColumn("stage", stage)
