"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    others = [p for p in (root / "kgeo").rglob("*.py") if "llm" not in p.parts]
    assert others and not [p for p in others if "kgeo.llm" in p.read_text()]
