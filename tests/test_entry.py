"""The driver's contract, also without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_every_query_has_a_callable_and_sql_names_queries():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert all(map(callable, queries.values())) and not set(__spark_entry__.oracle_sql()) - set(queries)
    assert all(n in __spark_entry__.oracle_sql() for n in queries if n.startswith("q_"))


def test_without_training_data_folders(tmp_path):
    shutil.copytree(ROOT / "tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if not n.startswith('q_')])"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    n, rest = said.split(" ", 1)
    assert int(n) > 90 and rest.strip() == "[]"
