"""The driver's contract."""

import __spark_entry__


def test_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "proof_chain5" in sql


def test_works_without_the_training_data_operators(monkeypatch):
    import importlib.util

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("weft.llm") else found(name, *a))
    assert "proof_chain5" in __spark_entry__.queries() and not any(n.startswith("op1_") for n in __spark_entry__.queries())
