"""The library and its queries work when the corpus operators are left out."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("textlab.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "vocab_top" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_them():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "textlab")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "textlab.llm" not in f.read(), name
