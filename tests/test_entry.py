import importlib
import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_core_stands_without_the_optional_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tallyloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tallyloom.llm", None)
    alone = importlib.reload(entry)
    assert not any(n[0] == "p" and n[1].isdigit() for n in alone.queries()) and "split_composition" in alone.queries()
    monkeypatch.undo()
    importlib.reload(entry)
