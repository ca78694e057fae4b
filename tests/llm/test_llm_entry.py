"""The subpackage is an extra: the library and its entry work without it."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def test_library_never_imports_the_subpackage():
    for path in (REPO / "vitalgrid").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "vitalgrid.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "vitalgrid"):
        (tmp_path / name).symlink_to(REPO / name)
    code = ("import sys, importlib.util as u; f = u.find_spec\n"
            "u.find_spec = lambda n, *a: None if n in ('vitalgrid.llm', 'corpus_pipeline') else f(n, *a)\n"
            "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not "
            "[x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
