"""The driver's contract without the optional subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_core_queries_without_the_subpackage(tmp_path, pipeline):
    kept = ["__spark_entry__.py", "quillspark"] + ["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists())
    for name in kept:
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quillspark/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'report_text' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_in_the_library_imports_the_subpackage():
    files = [p for p in (ROOT / "quillspark").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert files and not [p for p in files if re.search(r"\bllm\b", p.read_text(encoding="utf-8"))]


def test_work_folders_go_with_the_driver(tmp_path):
    code = """
import sys
from quillspark.session import build_session, drop_work, work_path, written
spark = build_session("local[1]", 1, **{"spark.checkpoint.dir": sys.argv[1]})
first = work_path(spark, "a")
spark.range(3).write.parquet(first)
assert written(spark.range(5), "b").count() == 5
dropped = work_path(spark, "c")
spark.range(3).write.parquet(dropped)
drop_work(spark, dropped)
import os
assert sorted(n[:2] for n in os.listdir(sys.argv[1]) if n[1] == "-") == ["a-", "b-"]
spark.stop()
"""
    (tmp_path / "work").mkdir()
    done = subprocess.run([sys.executable, "-B", "-c", code, str(tmp_path / "work")], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr
    assert not [p for p in (tmp_path / "work").iterdir() if p.name[1] == "-"]  # Spark's own checkpoint folder may be there
