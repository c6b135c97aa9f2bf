"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import duck_rows, spark_rows

from pathglow.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    columns, expected = duck_rows(catalog.ORACLES[name], data)
    assert sorted(df.columns) == columns
    assert spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_subpackage(tmp_path):
    """With the optional folders gone, the entry still imports and lists the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "pathglow", tmp_path / "pathglow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'unmapped_peaks' in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def test_entry_outlives_a_module_that_only_the_corpus_needs():
    """A module that the optional subpackage lacks costs its queries, not the others."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    code = "import sys, warnings; sys.modules['xxhash'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert 'unmapped_peaks' in q and 'op9_simhash_near_dedup' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=repo, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)
    broken = "import sys; sys.modules['pathglow.operators'] = None\ntry:\n    import __spark_entry__\nexcept ModuleNotFoundError:\n    sys.exit(0)\nsys.exit(1)"
    subprocess.run([sys.executable, "-B", "-c", broken], cwd=repo, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)
