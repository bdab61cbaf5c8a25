"""The entry point with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True)
    return out.stdout.split()


def copy_without(tmp_path, *gone):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str(Path(folder, n).relative_to(ROOT)) in gone])
    return to


def test_without_the_llm_folders(tmp_path):
    for gone in (("cueloom/llm", "tests/llm"), ("cueloom/llm", "tests/llm", "corpus_pipeline.py")):
        queries, _, llm = listed(copy_without(tmp_path / str(len(gone)), *gone))
        assert int(queries) > 100 and llm == "False"
