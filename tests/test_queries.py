from __future__ import annotations

import pytest

from parcella.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


def test_all_queries_but_two_have_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"frame_fit", "partition_trajectory"}


def test_entry_and_registry_without_the_llm_subpackage(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name.startswith("parcella.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLE_SQL)


def test_nothing_else_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "parcella"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "parcella.llm" not in f.read_text(), f
