import ast
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_nothing_imports_the_optional_subpackage():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "millrace").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_works_without_it(tmp_path):
    import shutil

    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n[0] == 'p' and n[1].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(not SMALL.exists(), reason="needs the test tables")
def test_every_core_query_runs(spark):
    from millrace.plans import catalogue

    for name, query in catalogue.queries().items():
        df = query(spark, str(SMALL))
        assert df.columns and len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
