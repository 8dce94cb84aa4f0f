import pytest

from basalt import queries as q

from .oracle import connect, expected, rows_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_matches_oracle(spark, con, name):
    assert rows_of(q.queries()[name](spark, SF)) == expected(con, q.oracle_sql()[name])
