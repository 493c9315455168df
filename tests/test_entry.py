"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() == 240 and found.filter("a is not null").count() > 100 and "a" in found.columns


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tidemark"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tidemark" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split()[1:] == ["False", "True"]


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text()
