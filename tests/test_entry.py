"""All queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracles import DATA, both
from trendloom.plans import text_queries

FOLDER = DATA / "sf0.001"


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(text_queries.SQL))
def test_query_equals_sql(spark, name):
    got, want = both(spark, text_queries.Q[name], text_queries.SQL[name], FOLDER)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_an_unrelated_import_error_is_not_swallowed():
    """The entry imported in a process of its own, with the subpackage absent, and with a module that it needs absent."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    block = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"
    run = lambda name: subprocess.run([sys.executable, "-c", block.format(name)], cwd=root, capture_output=True, text=True)
    absent = run("trendloom.llm")
    assert absent.returncode == 0 and absent.stdout.split()[1] == "False"
    if (root / "trendloom" / "llm").is_dir():
        broken = run("trendloom.llm.mixing")
        assert broken.returncode != 0 and "trendloom.llm.mixing" in broken.stderr
