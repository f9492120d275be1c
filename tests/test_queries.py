"""Every registered query of the core on the smallest data, beside its SQL where it has one."""

import pytest

from compare import differences, duck
from tracefold.plans import ledgers, problems, texts

SF = "/root/testdata/sf0.001"
QUERIES = {n: (q, m.SQL.get(n)) for m in (problems, ledgers, texts) for n, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q, sql = QUERIES[name]
    df = q(spark, SF)
    if sql:
        n, mine, theirs = differences(df, con, sql)
        assert not mine and not theirs, (list(mine)[:3], list(theirs)[:3])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
