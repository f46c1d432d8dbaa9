"""Every query of the corpus operators runs on the smallest tables and gives the rows of its SQL."""

import pytest

from veriscreen.llm import queries

from ..test_registered import compared, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_corpus_queries(spark, duck, name):  # noqa: F811
    compared(spark, duck, name)
