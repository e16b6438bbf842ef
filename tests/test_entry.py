import ast
import importlib
import sys
import warnings
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_of_queries_and_statements():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "verify_parts" in entry.queries()


def test_core_never_imports_the_training_operators():
    for path in ROOT.glob("attestra/**/*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("attestra.llm" in n or n == "corpus_pipeline" for n in names), path


@pytest.mark.parametrize("gone", ["attestra.llm", "corpus_pipeline"])
def test_entry_does_without_the_training_operators(monkeypatch, gone):
    class Hidden:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name == gone or name.startswith(gone + "."):
                raise ModuleNotFoundError(name, name=gone)

    for name in list(sys.modules):
        if name.startswith(("attestra.llm", "corpus_pipeline", "__spark_entry__")):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Hidden, *sys.meta_path])
    found = importlib.import_module("__spark_entry__").queries()
    assert "verify_parts" in found and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in found)


@pytest.mark.parametrize("gone", ["public_tokenizers", "tokenizers_of_no_one"])
def test_entry_does_without_optional_modules(monkeypatch, gone):
    class Hidden:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name == gone:
                raise ModuleNotFoundError(name, name=gone)

    for name in list(sys.modules):
        if name.startswith(("attestra.llm", "corpus_pipeline", "__spark_entry__", "public_tokenizers")):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Hidden, *sys.meta_path])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert "verify_parts" in importlib.import_module("__spark_entry__").queries()


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["doc_id", "page_no", "seq"] and df.columns[-2:] == ["reason_code", "verdict"]
