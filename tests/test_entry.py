"""The entry module works without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def counts(folder, code=COUNT):
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout
    return out.split()


def test_entry_without_the_optional_part(tmp_path):
    left_out = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    from reviewmill.plans.catalog import QUERIES
    from reviewmill.plans.oracle import ORACLE
    assert counts(tmp_path / "repo") == [str(len(QUERIES)), str(len(ORACLE)), "False"]


def test_entry_without_a_library_of_the_optional_part():
    from reviewmill.plans.catalog import QUERIES
    from reviewmill.plans.oracle import ORACLE
    code = "import sys; sys.modules['xxhash'] = None; " + COUNT
    assert counts(ROOT, code) == [str(len(QUERIES)), str(len(ORACLE)), "False"]
