import pytest
from pyspark.sql import functions as F

from corpuslens.functions import columns as C


@pytest.mark.parametrize(
    ("path", "lang", "category", "test", "entry"),
    [
        ("src/app.ts", "typescript", "code", False, True),
        ("Dockerfile.dev", "dockerfile", "infra", False, False),
        ("a/.gitignore", "config", "config", False, False),
        ("pkg/x_test.go", "go", "code", True, False),
        ("src/test-utils.ts", "typescript", "code", False, False),
        ("bin/test-run.sh", "shell", "script", True, False),
        ("cmd/tool/main.go", "go", "code", False, True),
        ("notes/readme", "other", "other", False, False),
        ("FooTests.java", "java", "code", True, False),
    ],
)
def test_paths(one, path, lang, category, test, entry):
    assert one(C.detect_language("p"), p=path) == lang
    assert one(C.category_of(C.detect_language("p")), p=path) == category
    assert one(C.is_test_path("p"), p=path) is test
    assert one(C.is_entry_path("p"), p=path) is entry


@pytest.mark.parametrize(("path", "stem"), [("mcp/test/paths.test.js", "paths"), ("test_user.py", "user"), ("UserTests.java", "user"), ("x/store_spec.rb", "store"), ("lib/Plain.js", "plain")])
def test_stem(one, path, stem):
    assert one(C.test_stem("p"), p=path) == stem


@pytest.mark.parametrize(("base", "spec", "out"), [("a/b", "../c.js", "a/c.js"), ("a", "./x//y", "a/x/y"), ("", "../../x", "x"), ("a/b/c", "../../..", "")])
def test_normalize(one, base, spec, out):
    assert one(C.normalize_path("b", "s"), b=base, s=spec) == out


@pytest.mark.parametrize(("path", "area"), [("README.md", "root"), ("src/api/x.ts", "src/api"), ("src/x.ts", "src"), ("docs/a/b.md", "docs")])
def test_area(one, path, area):
    assert one(C.area_key("p"), p=path) == area


def test_ancestors_and_dirs(one):
    assert one(C.ancestors("p"), p="a/b/c.txt") == ["a", "a/b"]
    assert one(C.ancestors("p"), p="c.txt") == []
    assert one(C.dir_of("p"), p="c.txt") == ""
    assert one(C.line_count("t"), t="") == 0
    assert one(C.line_count("t"), t="a\n") == 2


def test_frontmatter(one):
    text = '---\ntitle: "A note"\nstatus: active\n---\nbody\n---\ntitle: other\n'
    assert one(C.fm_value("t", "title"), t=text) == "A note"
    assert one(C.fm_value("t", "missing"), t=text) is None
    assert one(C.note_label("t", F.lit("x/y.md")), t="no header") == "y"
    assert one(C.note_body("t"), t=text).startswith("body")
    assert one(C.vault_layer("p"), p="context/me.md") == "Context"
    assert one(C.vault_layer("p"), p="me.md") == "Map"


@pytest.mark.parametrize(("cited", "ok"), [("lib/x.js", True), ("/abs/x.js", False), ("#a/b.js", False), ("tools/call", False), ("x.js", False), (".corpuslens/a.md", False), ("https://a.b/c.md", False), ("a/b.md#part", False)])
def test_citation_shape(one, cited, ok):
    assert one(C.is_path_citation("c"), c=cited) is ok


def test_citation_class(one):
    assert one(C.citation_class(F.lit("docs/adr/1.md"), F.lit("x"))) == "historical"
    assert one(C.citation_class(F.lit("a.md"), F.lit("was removed"))) == "historical"
    assert one(C.citation_class(F.lit("a.md"), F.lit("see x"))) == "suspected"


def test_shim(one):
    assert one(C.is_shim("t"), t="@AGENTS.md\n") is True
    assert one(C.is_shim("t"), t="") is False
    assert one(C.is_shim("t"), t="\n\n @AGENTS.md \n") is True
    assert one(C.is_shim("t"), t="@AGENTS.md\nmore") is False


def test_search(one):
    terms = C.tokenize(F.lit("AA b"))
    assert one(C.recall_score("t", terms), t="aaaaa B") == 3
    assert "needle" in one(C.snippet("t", F.array(F.lit("needle"))), t="x " * 300 + "needle" + " y" * 300)


@pytest.mark.parametrize(("prompt", "score", "skip"), [("make it nicer", 5, False), ("fix the api in src/app.ts today please now ok then yes", 0, True), ("yes", 5, True), ("is it done", 5, True), ("", 5, True), ("/cmd", 5, True)])
def test_prompts(one, prompt, score, skip):
    assert one(C.vagueness("p"), p=prompt) == score
    assert one(C.bypass("p"), p=prompt) is skip


def test_redaction(one):
    assert one(C.redact("s"), s="short") == "*****"
    assert one(C.redact("s"), s="abcdefghijklmnop") == "abcd********mnop"


def test_enrichment_cleaning(one):
    assert one(C.clean_role("r"), r=" Config ") == "config"
    assert one(C.clean_role("r"), r="wizard") is None
    assert len(one(C.clean_summary("s"), s="x" * 500)) == 400
    assert one(C.clean_tags(F.array(*[F.lit(x) for x in ("A", "a ", "", "b")]))) == ["a", "b"]
