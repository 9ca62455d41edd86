"""The queries that SQL can express, against their SQL."""

import pytest

from compare import connect, differences
from loglake.llm.catalog import llm_oracles, llm_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(llm_oracles()))
def test_matches_sql(spark, name):
    assert differences(llm_queries()[name](spark, SF_DIR), connect(SF_DIR), llm_oracles()[name]) == []


def test_all_are_registered():
    import __spark_entry__

    found = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
