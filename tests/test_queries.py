"""Every registered core query beside its oracle SQL, on the smallest tables."""

import importlib

import pytest

import __spark_entry__ as entry
from compare import compare

CORE = {k: (f, r.oracle.get(k)) for r in (importlib.import_module(m).R for m in entry.MODULES) for k, f in r.queries.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, oracle, name):
    query, sql = CORE[name]
    ok, said = compare(spark, oracle, sf, name, query, sql)
    assert ok, said


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["table_name", "field_id", "root_field_id", "field_depth"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_the_optional_package(monkeypatch):
    monkeypatch.setattr(entry, "OPTIONAL", ("lakeloom.llm_that_is_not_there",))
    with pytest.raises(ModuleNotFoundError):  # only the package llm itself may be missing
        monkeypatch.setattr(entry, "OPTIONAL", ("lakeloom.nothing",))
        entry.queries()
    monkeypatch.setattr(entry, "OPTIONAL", ("lakeloom.llm.absent",))
    assert set(entry.queries()) == set(CORE)


def test_workers_can_import_the_package_from_anywhere(spark):
    import os

    from lakeloom.session import ship

    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert root in ship(spark).sparkContext.environment["PYTHONPATH"].split(os.pathsep)
