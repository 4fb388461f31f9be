import importlib

import __spark_entry__ as entry


def test_names_and_sql_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 150 and len(o) / len(q) > 0.8


def test_smoke(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    from pathlib import Path

    import skarn

    for p in Path(skarn.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "skarn.llm" not in p.read_text(), p
    assert importlib.import_module("skarn.plans")
