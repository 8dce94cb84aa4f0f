import pytest

from basalt.llm import registry

from ..oracle import connect, expected, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, name):
    assert rows_of(registry.queries()[name](spark, SF)) == expected(connect(SF), registry.oracle_sql()[name])
