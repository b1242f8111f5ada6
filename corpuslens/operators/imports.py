"""Import extraction and resolution: specifiers become candidate paths, candidates meet files in one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..tables import shuffled


def _tagged(tag: str):
    return lambda spec: F.struct(F.lit(tag).alias("tag"), spec.alias("spec"))


def extract_imports(file_text: DataFrame) -> DataFrame:
    """repo_id, path, lang, spec, tag, pos for each specifier of file_text(repo_id, path, text)."""
    rows = file_text.withColumn("lang", C.detect_language("path")).select("repo_id", "path", "lang", "text")
    found = []
    for langs, tag, pattern in rules.IMPORTS:
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        found.append(F.when(F.col("lang").isin(langs.split()), F.transform(hits, _tagged(tag))))
    blocks = F.regexp_extract_all("text", F.lit(rules.GO_BLOCK), F.lit(1))
    lines = F.flatten(F.transform(blocks, lambda b: F.split(b, "\n")))
    quoted = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r'"([^"]+)"', 1)), lambda s: s != "")
    found.append(F.when(F.col("lang") == "go", F.transform(quoted, lambda s: F.struct(F.lit("block").alias("tag"), s.alias("spec")))))
    empty = F.array().cast("array<struct<tag:string,spec:string>>")
    every = F.concat(*[F.coalesce(x, empty) for x in found])
    # an absolute require that repeats a relative one is dropped; a relative one is marked
    near = F.array_distinct(F.transform(F.filter("found", lambda x: x["tag"] == "relative"), lambda x: x["spec"]))
    # the outer form, whose one null row for a file without imports goes below: before the other, Spark reads each text twice, the first time to see whether it finds any
    held = rows.withColumn("found", every).select("repo_id", "path", "lang", near.alias("near"), F.posexplode_outer("found").alias("pos", "x"))
    held = held.where((F.col("x.spec") != "") & ~((F.col("x.tag") == "require") & F.array_contains("near", F.col("x.spec"))))
    spec = F.when(F.col("x.tag") == "relative", F.concat(F.lit("./"), F.col("x.spec"))).otherwise(F.col("x.spec"))
    return held.select("repo_id", "path", "lang", spec.alias("spec"), "x.tag", "pos")


def _texts(names: list[str]) -> Column:
    return F.array(*map(F.lit, names))


def _numbered(arrays: list[Column]) -> Column:
    return F.filter(F.transform(F.concat(*arrays), lambda c, i: F.struct(i.alias("priority"), c.alias("candidate"))), lambda x: x["candidate"].isNotNull())


def _shortened(parts: Column) -> Column:
    """a/b/c, a/b, a"""
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def _parts(spec: str, by: str) -> Column:
    return F.filter(F.split(spec, by), lambda x: x != "")


def source_roots(files: DataFrame) -> DataFrame:
    """Java roots: what precedes src/main/java and the like, and the repository itself; longest first in root arrays."""
    own = files.where("lang = 'java'").select("repo_id", F.regexp_extract("path", r"^(.*?src/(?:main|test)/java)/", 1).alias("root")).where("root != ''").distinct()
    roots = own.groupBy("repo_id").agg(F.collect_set("root").alias("roots"))
    order = lambda x: F.sort_array(F.transform(x, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))), asc=False)
    return roots.select("repo_id", F.array_append(F.transform(order(F.col("roots")), lambda s: s["r"]), F.lit("")).alias("roots"))


def crate_roots(files: DataFrame) -> DataFrame:
    """Rust crate roots: directories of lib.rs and main.rs."""
    return files.where(F.col("path").rlike(r"(^|/)(lib|main)\.rs\z")).select("repo_id", C.dir_of("path").alias("root")).where("root != ''").distinct()


def load_paths(files: DataFrame) -> DataFrame:
    """Ruby load paths: up to the first lib/ of a path, and the repository itself."""
    own = files.where("lang = 'ruby'").select("repo_id", F.regexp_replace(F.regexp_extract("path", r"^(.*?lib/)", 1), r"/\z", "").alias("root")).distinct()
    ranked = own.groupBy("repo_id").agg(F.sort_array(F.collect_set(F.struct(F.length("root").alias("n"), F.col("root").alias("r"))), asc=False).alias("s"))
    return ranked.select("repo_id", F.array_union(F.transform("s", lambda x: x["r"]), F.array(F.lit(""))).alias("roots"))


def php_prefixes(manifests: DataFrame) -> DataFrame:
    """repo_id, prefix, dir from composer manifests: psr-4, else psr-0, of autoload and autoload-dev."""
    composer = manifests.where(F.col("path").rlike(r"(^|/)composer\.json\z") & F.col("parsed").isNotNull())
    both = []
    for section in ("autoload", "autoload-dev"):
        forms = []
        for psr in ("psr-4", "psr-0"):
            many, single = (F.try_variant_get("parsed", f"$['{section}']['{psr}']", f"map<string,{kind}>") for kind in ("array<string>", "string"))
            forms.append(F.when(many.isNotNull(), F.map_zip_with(many, single, lambda _, dirs, d: F.coalesce(dirs, F.array(d)))))
        both.append(composer.select("repo_id", "path", F.explode(F.coalesce(*forms)).alias("prefix", "dirs")))
    rows = reduce(DataFrame.unionByName, both).select("repo_id", "path", "prefix", F.explode("dirs").alias("d"))
    place = F.array_join(F.filter(F.array(C.dir_of("path"), F.regexp_replace("d", r"/+\z", "")), lambda x: x != ""), "/")
    return rows.select("repo_id", "prefix", place.alias("dir")).distinct()


def candidates(specs: DataFrame, files: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """repo_id, path, spec, pos, priority, candidate: the paths a specifier may mean, best first."""
    here, spec = C.dir_of("path"), F.col("spec")
    keep = ["repo_id", "path", "lang", "spec", "tag", "pos"]

    def out(df: DataFrame, arrays: list[Column]) -> DataFrame:
        return df.select(*keep, F.explode(_numbered(arrays)).alias("x")).select(*keep, "x.priority", "x.candidate")

    js = specs.where(F.col("lang").isin(rules.JS.split()) & spec.startswith(".")).withColumn("base", C.normalize_path(here, spec))
    stem = F.regexp_replace("base", r"\.js\z", "")
    js = out(js, [F.transform(_texts(rules.JS_SUFFIXES), lambda s: F.concat(F.col("base"), s)), F.when(F.col("base").endswith(".js"), F.transform(_texts([".ts", ".tsx", ".mts"]), lambda s: F.concat(stem, s))).otherwise(F.array().cast("array<string>"))])

    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    ups = F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/")
    rest = F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/")
    relative = C.normalize_path(here, F.concat_ws("/", ups, rest))
    absolute = F.translate("spec", ".", "/")
    py = specs.where("lang = 'python'")
    py = out(py, [F.when(dots > 0, F.array(F.concat(relative, F.lit(".py")), F.concat_ws("/", F.nullif(relative, F.lit("")), F.lit("__init__.py")))).otherwise(F.array(F.concat(absolute, F.lit(".py")), F.concat(absolute, F.lit("/__init__.py")), F.concat(F.lit("src/"), absolute, F.lit(".py"))))])

    sh = specs.where("lang = 'shell'").withColumn("cleaned", F.regexp_replace("spec", r"^\$\{?[A-Za-z_][A-Za-z0-9_]*\}?/", ""))
    sh = out(sh, [F.array(F.col("cleaned"), C.normalize_path(here, "cleaned"))])

    java = specs.where("lang = 'java'").join(source_roots(files), "repo_id", "left").withColumn("roots", F.coalesce("roots", F.array(F.lit(""))))
    tails = _shortened(_parts("spec", r"\."))
    java = out(java, [F.flatten(F.transform(tails, lambda t: F.transform("roots", lambda r: F.concat(F.when(r == "", F.lit("")).otherwise(F.concat(r, F.lit("/"))), t, F.lit(".java")))))])

    ruby = specs.where("lang = 'ruby'").join(load_paths(files), "repo_id", "left").withColumn("roots", F.coalesce("roots", F.array(F.lit(""))))
    base = C.normalize_path(here, spec)
    ruby = out(ruby, [F.when(spec.startswith("./"), F.array(F.concat(base, F.lit(".rb")), base)).otherwise(F.transform("roots", lambda r: F.concat(F.when(r == "", F.lit("")).otherwise(F.concat(r, F.lit("/"))), spec, F.lit(".rb"))))])

    name = F.regexp_replace(C.basename("path"), r"\.rs\z", "")
    own_dir = name.isin("lib", "main", "mod") | here.rlike(r"(^|/)(tests|benches|examples|src/bin)\z")
    module = F.when(own_dir, here).otherwise(F.concat_ws("/", F.nullif(here, F.lit("")), name))
    parts = _parts("spec", "::")
    child = F.concat_ws("/", F.nullif(module, F.lit("")), F.array_join(parts, "/"))
    up = C.ancestors("path")
    rooted = specs.where("lang = 'rust'").withColumn("up", F.explode_outer(up)).join(crate_roots(files).withColumnRenamed("root", "up"), ["repo_id", "up"], "left_semi")
    crate = rooted.groupBy(*keep).agg(F.max_by("up", F.length("up")).alias("crate"))
    rust = specs.where("lang = 'rust'").join(shuffled(crate.select("repo_id", "path", "spec", "pos", "crate")), ["repo_id", "path", "spec", "pos"], "left")
    from_root = F.when(F.col("crate").isNotNull(), F.flatten(F.transform(_shortened(parts), lambda t: F.array(F.concat_ws("/", "crate", F.concat(t, F.lit(".rs"))), F.concat_ws("/", "crate", t, F.lit("mod.rs")))))).otherwise(F.array().cast("array<string>"))
    rust = out(rust, [F.array(F.concat(child, F.lit(".rs")), F.concat(child, F.lit("/mod.rs"))), from_root])

    every = [js, py, sh, java, ruby, rust]
    if prefixes is not None:
        names = F.regexp_replace("spec", r"^\\+", "")
        php = specs.where("lang = 'php'").withColumn("ns", names).withColumn("known", F.explode(_namespaces(F.col("ns"))))
        php = php.join(prefixes.withColumnRenamed("prefix", "known"), ["repo_id", "known"])
        tail = _parts_of(F.expr("substring(ns, length(known) + 1)"), r"\\")
        php = php.where(F.size(tail) > 0).withColumn("candidate", F.concat(F.array_join(F.filter(F.concat(F.array("dir"), tail), lambda x: x != ""), "/"), F.lit(".php")))
        every.append(php.select(*keep, (-F.length("known")).alias("priority"), "candidate"))
    return reduce(DataFrame.unionByName, every)


def _parts_of(c: Column, by: str) -> Column:
    return F.filter(F.split(c, by), lambda x: x != "")


def _namespaces(ns: Column) -> Column:
    """Prefixes of a namespace that end at a separator, each with it and without."""
    ends = F.filter(F.sequence(F.lit(1), F.length(ns)), lambda i: F.substring(ns, i, F.lit(1)) == "\\")
    return F.array_union(F.flatten(F.transform(ends, lambda i: F.array(F.substring(ns, F.lit(1), i), F.substring(ns, F.lit(1), i - 1)))), F.array(F.lit("")))


def _seen_from() -> Column:
    """What of a path the candidates of its specifier depend on: all in Rust, the directory of a relative one, else nothing.

    It stands for the path in ``candidates``; a directory ends with its separator.
    """
    lang, spec = F.col("lang"), F.col("spec")
    directory = F.left(F.col("path"), F.length("path") - F.length(C.basename("path")))
    rooted = lang.isin("java", "php") | ((lang == "python") & ~spec.startswith(".")) | ((lang == "ruby") & ~spec.startswith("./"))
    return F.when(lang == "rust", F.col("path")).when(rooted, "").otherwise(directory)


def resolve_imports(specs: DataFrame, files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """repo_id, path, spec, target: the first candidate that exists; a Go package means all its files.

    What many files of a repository or directory say alike is looked up once.
    """
    said = specs.where(~F.col("lang").isin(rules.JS.split()) | F.col("spec").startswith(".")).select("repo_id", "path", "lang", "spec", _seen_from().alias("seen_from"))
    asked = said.select("repo_id", F.col("seen_from").alias("path"), "lang", "spec").distinct().withColumns({"tag": F.lit(""), "pos": F.lit(0)})
    found = candidates(asked, files, php_prefixes(manifests) if manifests is not None else None)
    known = files.select("repo_id", F.col("path").alias("candidate"))
    first = found.join(shuffled(known), ["repo_id", "candidate"]).groupBy("repo_id", F.col("path").alias("seen_from"), "lang", "spec").agg(F.min_by("candidate", F.struct("priority", "candidate")).alias("target"))
    resolved = said.join(shuffled(first), ["repo_id", "seen_from", "lang", "spec"]).select("repo_id", "path", "spec", "target")
    if manifests is not None:
        modules = manifests.where("path = 'go.mod'").select("repo_id", C.go_module("text").alias("module")).where("module is not null")
        go = specs.where("lang = 'go'").join(modules, "repo_id").where((F.col("spec") == F.col("module")) | F.expr("startswith(spec, module || '/')"))
        go = go.withColumn("dir", F.expr("case when spec = module then '' else substring(spec, length(module) + 2) end"))
        own = files.where("lang = 'go' and not is_test").select("repo_id", F.col("path").alias("target"), C.dir_of("path").alias("dir"))
        resolved = resolved.unionByName(go.join(shuffled(own), ["repo_id", "dir"]).select("repo_id", "path", "spec", "target"))
    return resolved


def build_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct import edges of code and script files, without self edges.

    An inner join, as the distinct edges need the rows where it leaves them; a semi join would be
    pushed below the lookups of ``resolve_imports``.
    """
    able = files.where("category in ('code', 'script')").select("repo_id", "path")
    rows = resolved.where("path != target").join(shuffled(able), ["repo_id", "path"])
    return rows.select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("type")).dropDuplicates()


def dangling_imports(specs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Relative specifiers outside tests that resolve to nothing."""
    return specs.where(F.col("spec").startswith(".") & ~C.is_test_path("path")).join(shuffled(resolved), ["repo_id", "path", "spec"], "left_anti")


def external_packages(specs: DataFrame, builtins: DataFrame) -> DataFrame:
    """Packages that files outside tests import: scope and name of specifiers neither relative nor built in."""
    named = specs.where(~F.col("spec").rlike(r"^[./]") & ~C.is_test_path("path") & ~F.col("spec").startswith("node:"))
    package = F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    return named.select("repo_id", package.alias("package")).distinct().join(builtins.select("package"), "package", "left_anti")


def undeclared(packages: DataFrame, declared: DataFrame) -> DataFrame:
    return packages.join(declared.select("repo_id", "package"), ["repo_id", "package"], "left_anti")
