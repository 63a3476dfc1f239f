"""Every registered query with an oracle: Spark result == DuckDB result
(same columns, same rows, values compared after normalisation)."""

import pytest

from conftest import SF_SMALL
from sparktab.plans.registry import load_all
from tools.check import rows_of

ORACLE = sorted(n for n, e in load_all().items() if e.sql)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_oracle(spark, duck, name):
    e = load_all()[name]
    got = e.build(spark, SF_SMALL).toPandas()
    exp = duck.execute(e.sql).df()
    gc, gr = rows_of(got)
    ec, er = rows_of(exp)
    assert gc == ec
    assert len(gr) == len(er)
    assert gr == er
