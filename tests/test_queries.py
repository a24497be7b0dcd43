"""Every registered query of the engine runs; those with SQL give the same rows."""

import pytest

from tessera import registry
from tests.conftest import normal, same_as_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_the_same_rows_again(spark, sf_dir, name):
    """Queries without SQL; their values are held against brute force in test_operators and test_layouts."""
    first, again = (normal(tuple(r) for r in QUERIES[name](spark, sf_dir).collect()) for _ in range(2))
    assert first and first == again


def test_entry_with_left_over_byte_code(monkeypatch, spark):
    """A deleted subpackage may leave a folder behind; then the first missing module is one inside it."""
    import importlib
    import sys

    import __spark_entry__ as entry

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tessera.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tessera.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    importlib.reload(entry)
    assert "clip" in entry.queries() and not any(n.startswith("op1_") for n in entry.queries())


def test_entry_without_the_corpus_subpackage(monkeypatch, spark):
    """The entry module works when the corpus subpackage cannot be found."""
    import importlib
    import sys

    import __spark_entry__ as entry

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "tessera.llm") or name.startswith("tessera.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tessera.llm")]:
        monkeypatch.delitem(sys.modules, m)
    import tessera

    monkeypatch.delattr(tessera, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    importlib.reload(entry)
    assert "clip" in entry.queries() and not any(n.startswith("op1_") for n in entry.queries())
    assert entry.entry(spark).count() > 0
