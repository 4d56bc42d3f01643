"""The entry without the operators for training data."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT

RUN = """
import __spark_entry__ as e
from barrio.session import build_session
names = e.queries()
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= set(names)
spark = build_session("alone", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
print("rows", names["n1_fold_upper"](spark, "%s").count())
"""


def test_entry_without_the_llm_folders(tmp_path, data):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    for left in ([], [copy / "corpus_pipeline.py"]):
        for path in left:
            os.remove(path)
        code = RUN.replace("%s", data)
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
        assert out.returncode == 0 and "rows " in out.stdout, out.stderr[-2000:]
