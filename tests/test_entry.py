import pytest

import __spark_entry__ as E
from tests_support import compare

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", [n for n in E.queries() if not n.startswith(("p2", "p4", "p5", "p6", "p7", "p8"))])
def test_query(spark, name):
    compare(spark, name, SF)
