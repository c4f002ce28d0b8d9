from __future__ import annotations

import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "larkspan").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "larkspan").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_registers_without_the_optional_subpackage(monkeypatch):
    import importlib

    real = importlib.import_module

    def without(name, *args):
        if name.startswith("larkspan.llm"):
            raise ModuleNotFoundError(f"No module named '{name}'", name="larkspan.llm")
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", without)
    assert "search_tiered" in entry.queries()
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in entry.queries())
