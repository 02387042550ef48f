"""Every registered query against its SQL, over whole tables."""

import pytest

from loomcraft.catalog import QUERIES, SQL
from tests.conftest import SF
from tools.compare import spark_rows, sql_rows

NO_SQL: set[str] = set()


def test_all_but_the_named_have_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert not [n for n in QUERIES if n.startswith("op") and n[2:3].isdigit()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    columns, mine = spark_rows(spark, SF, name)
    have, theirs = sql_rows(db, name)
    assert columns == have
    assert mine, "no rows"
    assert mine == theirs
