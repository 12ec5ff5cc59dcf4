"""The driver's entry points, with and without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("segmentflow.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "rfm_panel" in e.queries() and "pipeline" not in e.queries() and not any(n.startswith("op") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True, timeout=120)
