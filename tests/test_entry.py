"""The registry: every twin has its query, names follow the problems, and the rest works without the llm folder."""

import ast
from pathlib import Path

import __spark_entry__ as entry

HOME = Path(entry.__file__).parent


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p2_found", "p4_found", "p5_found", "p6_found"} <= set(queries)


def test_nothing_imports_the_llm_folder():
    for path in (HOME / "mnemolake").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("mnemolake.llm") for n in names), path
