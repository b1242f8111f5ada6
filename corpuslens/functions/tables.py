"""SQL table functions: what a text holds, row by row, for use in a lateral join.

They are SQL functions, so a query that uses them is planned as if it were written out; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import rules
from .columns import any_of


def quoted(text: str) -> str:
    """A string as a literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in pairs.items()) + ")"


def _hits(kind: str, words: list[str], pattern: str) -> str:
    """Matches of one rule with their lines; the pattern runs only where a word of it occurs."""
    before = f"concat(array_join(slice(split(body, {quoted(pattern)}, -1), 1, k + 1), ''), array_join(slice(found, 1, k), ''))"
    row = f"named_struct('kind', {quoted(kind)}, 'line', cast(1 + length({before}) - length(replace({before}, '\\n', '')) as int), 'match', m)"
    tried = " or ".join(f"contains(lower(body), {quoted(w)})" for w in words)
    return f"case when {tried} then flatten(transform(array(regexp_extract_all(body, {quoted(pattern)}, 0)), found -> transform(found, (m, k) -> {row}))) else array() end"


def secrets_function() -> str:
    """secrets_of(body): kind, line, match_redacted; as ``operators.secrets.scan_secrets``."""
    every = ", ".join(_hits(*rule) for rule in rules.SECRETS)
    value = """case when rlike(x.match, '[\\'"]([^\\'"\\n]*)[\\'"]') then regexp_extract(x.match, '[\\'"]([^\\'"\\n]*)[\\'"]', 1) else x.match end"""
    redacted = "case when length(x.match) <= 12 then repeat('*', length(x.match)) else concat(substring(x.match, 1, 4), '********', right(x.match, 4)) end"
    return f"""
        create or replace temporary function secrets_of(body string) returns table (kind string, line int, match_redacted string)
        return select x.kind, x.line, {redacted} from explode(concat({every})) as t(x) where not rlike({value}, {quoted(any_of(rules.PLACEHOLDERS))})"""


def imports_function() -> str:
    """imports_of(path, body): spec, tag, pos; as ``operators.imports.extract_imports``."""
    name = "lower(substring_index(path, '/', -1))"
    ext = f"case when contains({name}, '.') then substring_index({name}, '.', -1) else '' end"
    lang = f"coalesce(try_element_at({_map(rules.LANGUAGE_BY_NAME)}, {name}), try_element_at({_map(rules.LANGUAGE_BY_EXTENSION)}, {ext}), 'other')"
    tagged = lambda found, tag: f"transform({found}, s -> named_struct('tag', {quoted(tag)}, 'spec', s))"
    forms = [f"case when lang in ({', '.join(map(quoted, langs.split()))}) then {tagged(f'regexp_extract_all(body, {quoted(pattern)}, 1)', tag)} else array() end" for langs, tag, pattern in rules.IMPORTS]
    lines = f"flatten(transform(regexp_extract_all(body, {quoted(rules.GO_BLOCK)}, 1), b -> split(b, '\\n')))"
    block = f"""filter(transform({lines}, x -> regexp_extract(x, '"([^"]+)"', 1)), s -> s != '')"""
    forms.append(f"case when lang = 'go' then {tagged(block, 'block')} else array() end")
    every = f"transform(array({lang}), lang -> concat({', '.join(forms)}))"
    # an absolute require that repeats a relative one is dropped; a relative one is marked
    twin = "x.tag = 'require' and exists(found, y -> y.tag = 'relative' and y.spec = x.spec)"
    placed = "transform(found, (x, pos) -> named_struct('spec', x.spec, 'tag', x.tag, 'pos', pos))"
    return f"""
        create or replace temporary function imports_of(path string, body string) returns table (spec string, tag string, pos int)
        return select case when x.tag = 'relative' then concat('./', x.spec) else x.spec end, x.tag, x.pos
        from explode(flatten(transform({every}, found -> filter({placed}, x -> x.spec != '' and not ({twin}))))) as t(x)"""


def register(spark: SparkSession) -> None:
    """Makes secrets_of and imports_of known in this session."""
    spark.sql(secrets_function())
    spark.sql(imports_function())
