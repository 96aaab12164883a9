"""The driver's entry points, from another working folder and without the optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code, folder, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(folder)!r})\n{code}"], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)


def test_python_workers_from_another_folder(tmp_path):
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print(e.queries()["ewma_zscore"](spark, "/root/testdata/sf0.001").count())
"""
    done = run(code, ROOT, tmp_path)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) == 1000, done.stderr[-2000:]


def test_optional_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py"))
    done = run("import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q)", copy, tmp_path)
    assert done.returncode == 0 and done.stdout.split()[-1] == "False" and int(done.stdout.split()[0]) > 100, done.stderr[-2000:]
    # a broken import inside the part is no missing part
    (copy / "spanwell" / "llm").mkdir()
    (copy / "spanwell" / "llm" / "__init__.py").write_text("")
    (copy / "spanwell" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    done = run("import __spark_entry__", copy, tmp_path)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
