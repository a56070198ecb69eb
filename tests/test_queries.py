"""Every query of the linkage operators against its SQL, or for those without, that it has rows."""

import pytest

from kindred.queries import ORACLE_SQL, QUERIES
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_operators():
    """The entry works where the optional subpackage and the pipeline are absent."""
    import subprocess
    import sys

    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("kindred.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "j1_exact_key_capped" in e.queries() and "pipeline" not in e.queries() and not [q for q in e.queries() if q.startswith("op")]
"""
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
