import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    for path in (ROOT / "textloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("textloom.llm") or n == "corpus_pipeline" for n in names), path
