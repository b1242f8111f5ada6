"""Column functions over paths, notes, prompts and secrets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row although lambdas use it often."""
    return F.element_at(F.transform(F.array(value), then), 1)


# paths


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dir_of(path: Column | str) -> Column:
    """Directory, empty at the root."""
    return F.regexp_extract(col(path), r"^(?s:(.*))/[^/]*\z", 1)


def ext_of(path: Column | str) -> Column:
    """Lower-case extension of the name, empty without a dot."""
    name = F.lower(basename(path))
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")


def detect_language(path: Column | str) -> Column:
    name = F.lower(basename(path))
    return F.coalesce(
        F.try_element_at(_lookup(rules.LANGUAGE_BY_NAME), name),
        F.when(name.startswith("dockerfile"), "dockerfile"),
        F.try_element_at(_lookup(rules.LANGUAGE_BY_EXTENSION), ext_of(path)),
        F.when(col(path).isNotNull(), "other"),
    )


def category_of(lang: Column | str) -> Column:
    by_lang = {x: c for c, langs in rules.CATEGORY.items() for x in langs}
    return F.coalesce(F.try_element_at(_lookup(by_lang), col(lang)), F.when(col(lang).isNotNull(), "other"))


def is_test_path(path: Column | str) -> Column:
    return col(path).rlike(any_of(rules.TEST_PATHS))


def is_entry_path(path: Column | str) -> Column:
    return col(path).rlike(any_of(rules.ENTRY_PATHS))


def is_fixture_path(path: Column | str) -> Column:
    return col(path).rlike(rules.FIXTURE_PATH)


def test_stem(path: Column | str) -> Column:
    """The name a test and what it tests share."""
    name = F.regexp_replace(basename(path), r"(?i)\.[a-z0-9]+\z", "")
    for pattern in (r"(?i)\.(test|spec)\z", r"(?i)_(test|spec)\z", r"(?i)^(test|spec)_", r"(Test|Tests|Spec|Specs)\z"):
        name = F.regexp_replace(name, pattern, "")
    return F.lower(name)


def area_key(path: Column | str) -> Column:
    parts = F.split(col(path), "/")
    first = F.get(parts, F.lit(0))
    return F.when(F.size(parts) == 1, "root").when(first.isin(rules.TRANSPARENT_DIRS) & (F.size(parts) > 2), F.concat_ws("/", first, F.get(parts, F.lit(1)))).otherwise(first)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), r"^-|-\z", "")


def area_slug(c: Column | str) -> Column:
    return F.when(slug(c) == "", "root").otherwise(slug(c))


def note_id(c: Column | str) -> Column:
    return slug(F.regexp_replace(col(c), r"\.md\z", ""))


def normalize_path(base_dir: Column | str, spec: Column | str) -> Column:
    """spec seen from base_dir; ``..`` above the root stays at the root."""
    parts = F.split(F.concat_ws("/", col(base_dir), col(spec)), "/")
    start = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, start, step), "/")


def clean_input_path(path: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(path), "\\", "/"), r"^\./", "")


def ancestors(path: Column | str) -> Column:
    """All directories above a path, the nearest last; the root is not one."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def line_count(text: Column | str) -> Column:
    return F.when(F.coalesce(col(text), F.lit("")) == "", 0).otherwise(F.size(F.split(col(text), "\n", -1)))


# citations and notes


def is_path_citation(c: Column | str) -> Column:
    x = col(c)
    return F.contains(x, F.lit("/")) & ~x.rlike(r"^[/#]") & x.rlike(r"\.[A-Za-z0-9]{1,6}\z") & ~x.startswith(".corpuslens/") & ~x.rlike(r"(?i)^[a-z]+://")


def citation_class(doc: Column | str, line: Column | str) -> Column:
    return F.when(col(doc).rlike(r"(?i)(^|/)docs/adr/") | col(line).rlike(rules.ABSENCE), "historical").otherwise("suspected")


def excerpt(line: Column | str, width: int = 120) -> Column:
    """A line without the white space around it, cut to a width."""
    return F.substring(F.regexp_replace(col(line), r"^\s+|\s+\z", ""), 1, width)


def strip(c: Column | str) -> Column:
    """Without the white space around it, that of Unicode included."""
    return F.regexp_replace(col(c), rf"^{rules.BLANK}+|{rules.BLANK}+\z", "")


def is_shim(text: Column | str) -> Column:
    """A text of one line that only points at another document; an empty text is none."""
    body = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s+|\s+\z", "")
    return ~F.contains(body, F.lit("\n")) & body.rlike(r"^@\S+\.md\z")


def frontmatter(text: Column | str) -> Column:
    return F.regexp_extract(col(text), r"^---[ \t]*\r?\n((?s:.*?))(?:^|\n)---[ \t]*(?:\r?\n|\z)", 1)


def fm_value(text: Column | str, key: str) -> Column:
    """A key of the first frontmatter block without its quotes; null if absent or empty."""
    found = F.regexp_extract(frontmatter(text), rf"(?m)^{key}:[ \t]*([^\r\n]*)", 1)
    return F.nullif(F.regexp_replace(found, r'^"|"\s*\z', ""), F.lit(""))


def note_label(text: Column | str, path: Column | str) -> Column:
    return F.coalesce(fm_value(text, "title"), fm_value(text, "name"), F.regexp_replace(basename(path), r"\.md\z", ""))


def note_body(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"^---[ \t]*\r?\n(?s:.*?)\n---[ \t]*(?:\r?\n|\z)", "")


def vault_layer(path: Column | str) -> Column:
    top = F.when(F.contains(col(path), F.lit("/")), F.substring_index(col(path), "/", 1)).otherwise(".")
    return F.coalesce(F.try_element_at(_lookup(rules.NOTE_LAYERS), top), top)


def glossary_needle(heading: Column | str) -> Column:
    text = F.trim(F.regexp_replace(col(heading), r"[`*_]", ""))
    return F.when(F.length(text) <= 40, F.regexp_replace(F.lower(text), r"\s+", "-"))


def go_module(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(text), r"(?m)^\s*module\s+(\S+)", 1), F.lit(""))


# dates, sizes


def day_stamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def clock(ts: Column | str) -> Column:
    return F.date_format(col(ts), "HH:mm")


def age_days(ts: Column | str, now: Column) -> Column:
    return F.datediff(now, col(ts))


def is_dormant(ts: Column | str, now: Column, days: int = 180) -> Column:
    """Older than days; an unreadable time is not dormant."""
    return F.coalesce((F.unix_timestamp(col(ts)) > 0) & (age_days(ts, now) > days), F.lit(False))


def est_tokens(size: Column | str) -> Column:
    return F.floor(col(size) / 4).cast("long")


def load_class(path: Column | str) -> Column:
    return F.when(basename(path).isin("AGENTS.md", "CLAUDE.md", "GEMINI.md"), "always").otherwise("on-demand")


# search


def tokenize(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def grams(text: Column | str, size: int) -> Column:
    """All runs of so many characters of a text, in order."""
    x = col(text)
    starts = F.when(F.length(x) >= size, F.sequence(F.lit(1), F.length(x) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(x, i, F.lit(size)))


def term_count(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def recall_score(text: Column | str, terms: Column) -> Column:
    return let(F.lower(col(text)), lambda t: F.aggregate(terms, F.lit(0).cast("long"), lambda acc, x: acc + term_count(t, x)))


def snippet(text: Column | str, terms: Column, width: int = 200, before: int = 60) -> Column:
    at = F.array_min(F.filter(F.transform(terms, lambda x: F.instr(F.lower(col(text)), x)), lambda i: i > 0))
    return F.trim(F.regexp_replace(F.substring(col(text), F.greatest(F.coalesce(at, F.lit(1)) - before, F.lit(1)), F.lit(width)), r"\s+", " "))


# prompts


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != ""))


def vagueness(prompt: Column | str) -> Column:
    p = F.coalesce(col(prompt), F.lit(""))
    return F.when(word_count(p) < 10, 2).otherwise(0) + sum((~p.rlike(x)).cast("int") for x in (rules.ACTION_VERBS, rules.COMPONENT_REF, rules.DOMAIN_WORDS))


def bypass(prompt: Column | str) -> Column:
    p = F.trim(F.coalesce(col(prompt), F.lit("")))
    n = word_count(p)
    return (p == "") | p.startswith("/") | (F.length(p) > 2000) | (n > 60) | ((n <= 2) & p.rlike(rules.STEER_WORDS)) | ((n <= 8) & p.rlike(rules.STATUS_QUESTION)) | p.rlike(rules.BYPASS_WORDS) | p.rlike(rules.FILE_LOCATOR)


# secrets


def redact(c: Column | str) -> Column:
    x = col(c)
    return F.when(F.length(x) <= 12, F.repeat(F.lit("*"), F.length(x))).otherwise(F.concat(F.substring(x, 1, 4), F.lit("*" * 8), F.right(x, F.lit(4))))


def is_placeholder(match: Column | str) -> Column:
    m = col(match)
    quoted = r"""['"]([^'"\n]*)['"]"""
    value = F.when(m.rlike(quoted), F.regexp_extract(m, quoted, 1)).otherwise(m)
    return value.rlike(any_of(rules.PLACEHOLDERS))


# enrichment


def clean_summary(c: Column | str) -> Column:
    x = strip(c)
    return F.when(F.length(x) > 400, F.concat(F.substring(x, 1, 399), F.lit("…"))).otherwise(x)


def clean_role(c: Column | str) -> Column:
    x = F.lower(strip(c))
    return F.when(x.isin(rules.ROLES), x)


def clean_tags(c: Column | str) -> Column:
    tags = F.coalesce(col(c), F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(strip(t))), lambda t: t != "")), 1, 8)
