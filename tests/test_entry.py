"""The driver's entry points, with and without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"


def shown(root):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=root, capture_output=True, text=True, timeout=120)


def copied(tmp_path, *leave_out):
    for name in ("meterglass", "__spark_entry__.py", "corpus_pipeline.py"):
        if name in leave_out:
            continue
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=lambda d, names: [n for n in names if n == "__pycache__" or f"{Path(d).name}/{n}" in leave_out])
        else:
            shutil.copy(ROOT / name, tmp_path / name)
    return shown(tmp_path)


def test_without_the_training_data_package(tmp_path):
    for k, leave_out in enumerate((("meterglass/llm",), ("meterglass/llm", "corpus_pipeline.py"))):
        (tmp_path / str(k)).mkdir()
        out = copied(tmp_path / str(k), *leave_out)
        assert out.returncode == 0, out.stderr
        n, pipeline, op1 = out.stdout.split()
        assert int(n) > 60 and pipeline == op1 == "False"


def test_nothing_else_imports_it():
    for f in (ROOT / "meterglass").rglob("*.py"):
        if "llm" not in f.parts:
            text = f.read_text()
            assert "meterglass.llm" not in text and ".llm import" not in text and "import llm" not in text, f
