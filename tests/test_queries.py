"""Every registered query runs, and equals its SQL where it has some."""

import pytest

from quillstrata.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, same, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, duck.sql(ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry_works_without_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['quillstrata.llm'] = None; import __spark_entry__ as e; assert 'price_factors' in e.queries(); assert not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
