"""Nothing outside the llm subpackage imports it."""

import ast
import pathlib

ROOT = pathlib.Path(__file__).parent.parent


def test_no_import_of_llm():
    for p in (ROOT / "millrace").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "millrace").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[0] == "doc_id" and df.count() > 0
