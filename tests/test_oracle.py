"""Every query next to its SQL on the smallest tables; size and skew checks."""

import os
import re

import pytest

from gradewright.catalog import ORACLES, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, SF, QUERIES[name], ORACLES.get(name)) is None


def test_every_survey_operator_has_a_query():
    named = {p.upper() for q in QUERIES for p in re.findall(r"[a-z]\d\d", q)}
    want = {f"{k}{i:02d}" for k, n in dict(S=7, K=7, F=14, P=8, J=8, A=19, W=7, L=4, U=3, M=6, X=24, G=4, C=4, R=7, E=9, T=3).items() for i in range(1, n + 1)}
    assert want - named == set()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["reason_code", "n", "pct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
