"""The entry points without the optional subpackage, or with one that cannot be imported."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import builtins, warnings
plain = builtins.__import__
def absent(name, *rest, **more):
    if any(name == b or name.startswith(b + ".") for b in {blocked!r}):
        raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
    return plain(name, *rest, **more)
builtins.__import__ = absent
import __spark_entry__ as e
names = set(e.queries())
print(len(names), any(n.startswith("op1_") for n in names), set(e.oracle_sql()) <= names)
"""


def said(blocked: list[str]) -> str:
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()[0], "left out" in done.stderr


@pytest.mark.skipif(not (ROOT / "lexloom" / "llm").is_dir(), reason="the subpackage is not here")
def test_a_missing_library_leaves_the_other_queries():
    n, warned = said(["xxhash"])
    assert int(n) > 50 and warned


def test_the_other_queries_alone():
    n, _ = said(["lexloom.llm"])
    assert int(n) > 50
