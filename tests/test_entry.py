"""The driver's entry, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    (tmp_path / "wardline").mkdir()
    for p in ROOT.joinpath("wardline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "wardline" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p and p != {str(ROOT)!r}]; import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(k.startswith('op') for k in q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False"
