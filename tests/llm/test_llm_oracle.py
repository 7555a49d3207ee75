import os

import pytest
from compare import connect, difference

from ledgerloom.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in queries.SQL:
        assert difference(df, connect(DATA), queries.SQL[name]) is None
    else:
        assert df.count() > 0
