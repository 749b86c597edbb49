"""Without brindle/llm, tests/llm and corpus_pipeline.py everything else imports and its tests are found."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    leave = {".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])}
    shutil.copytree(REPO, tmp_path / "repo", ignore=lambda _, names: leave & set(names))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path / "repo", check=True, stdout=subprocess.DEVNULL)


def test_nothing_else_imports_llm():
    own = [p for p in (REPO / "brindle").rglob("*.py") if "llm" not in p.relative_to(REPO).parts]
    assert own and not [p for p in own if re.search(r"(import|from)\b.*\bllm\b", p.read_text())]
