"""The entry points, with and without the part that may be left out."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
LISTING = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"


def listed(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", LISTING], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_without_the_optional_part(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copy(REPO / "__spark_entry__.py", copy)
    shutil.copytree(REPO / "ingestctl", copy / "ingestctl", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    own = listed(copy)
    assert "ingest_delimited_pipe" in own
    for name in ("__spark_entry__", "corpus_pipeline"):  # the pipeline may still lie there
        if (REPO / f"{name}.py").exists():
            shutil.copy(REPO / f"{name}.py", copy)
    assert listed(copy) == own
    assert set(own) <= set(listed(REPO))
