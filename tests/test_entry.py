import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and callable(e.entry)


def test_the_rest_works_without_the_text_folders(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'blobs' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True).returncode == 0
    tests = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_text.py", "tests/test_layout.py"], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert tests.returncode == 0, tests.stdout[-2000:]


def test_entry(spark):
    import pytest

    if not DATA.exists():
        pytest.skip("no tables here")
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["image_id", "color_id", "matches"] and not e.entry(spark).isEmpty()


def test_nothing_else_imports_the_text_folder():
    for p in (ROOT / "fernglass").rglob("*.py"):
        if "llm" not in p.parts:
            assert "fernglass.llm" not in p.read_text(), p
    assert importlib.util.find_spec("fernglass")
