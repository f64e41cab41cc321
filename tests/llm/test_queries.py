"""Queries of the subpackage against their SQL, on the smallest tables."""

from pathlib import Path

import pytest

from ledgerlens.llm import queries
from tests.test_oracle import FOLDER, duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, FOLDER)
    values = [tuple(r) for r in got.collect()]
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name])
        assert rows(got.columns, values) == rows([c[0] for c in want.description], want.fetchall())
    else:
        assert values
