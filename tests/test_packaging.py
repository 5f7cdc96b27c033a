"""The engine stands without the training-data part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

CODE = """
import importlib, pkgutil, sys

class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "docloom.llm" or name.startswith("docloom.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Block())
import docloom
for m in pkgutil.walk_packages(docloom.__path__, "docloom."):
    if not m.name.startswith("docloom.llm"):
        importlib.import_module(m.name)
import __spark_entry__ as e
names = list(e.queries())
assert len(names) > 140 and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(e.oracle_sql()) <= set(names)
"""


def test_engine_imports_without_llm():
    run = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_nothing_else_names_llm():
    for p in (ROOT / "docloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "docloom").parts:
            assert "docloom.llm" not in p.read_text(), p
