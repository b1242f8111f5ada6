"""Every registered query over a small folder of tables: against its SQL, or that it gives rows."""

import oracle
import pytest

from corpuslens.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert oracle.differences(df, registry.ORACLE_SQL[name], con) == ""
    else:
        assert df.count() > 0


def test_entry_stands_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("corpuslens.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("corpus_pipeline", "corpuslens.llm"):
        monkeypatch.setitem(sys.modules, name, None)
    again = importlib.reload(entry)
    assert "hotspots" in again.queries() and not any(n.startswith("op") and n[2].isdigit() for n in again.queries())
    monkeypatch.undo()
    importlib.reload(entry)
