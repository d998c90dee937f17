import pytest

from factloom import catalog

from .conftest import DATA
from .oracle import compared, connect


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_duckdb(spark, con, name):
    own, other = compared(catalog.queries()[name](spark, f"{DATA}/sf0.001"), con, catalog.oracle_sql()[name])
    assert own == other
