"""Every query of the library against the SQL that says the same."""

import pytest
from helpers import DATA, table_of

from lattica.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        assert table_of(got) == table_of(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["pre_id", "post_id", "distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
