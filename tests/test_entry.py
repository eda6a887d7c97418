"""The driver's contract."""

import importlib
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_optional_part(monkeypatch):
    import importlib.util as util

    real = util.find_spec
    monkeypatch.setattr(entry, "find_spec", lambda name: None if name.startswith(("tabulon.llm", "corpus_pipeline")) else real(name))
    names = set(entry.queries())
    assert "lineitem_quality" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert "tabulon.plans.catalog" in sys.modules and importlib.import_module("tabulon.plans.catalog").QUERIES.keys() == names
