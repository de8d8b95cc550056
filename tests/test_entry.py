"""The library without its training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "quillspan"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if (ROOT / name).is_dir() else {}))
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_the_rest_does_not_import_them():
    for path in (ROOT / "quillspan").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quillspan.llm" not in path.read_text()
