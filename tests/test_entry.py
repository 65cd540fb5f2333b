"""The entry points work where the optional subpackage is absent."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_folders(tmp_path):
    shutil.copytree(f"{ROOT}/promoscope", tmp_path / "promoscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(*q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert "trend_sprint" in said.stdout and "op1_" not in said.stdout and "pipeline" not in said.stdout
