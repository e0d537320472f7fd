"""Every operator bound to the test tables, with its SQL counterpart.

The tables hold invented Latin-script prose, so the queries pass dictionaries of
word parts that occur in it. The Japanese defaults are covered by the tests.
"""

from gradewright.catalog.registry import ORACLES, QUERIES

from gradewright.catalog import (  # noqa: F401, E402 - each module registers its queries
    answering,
    curating,
    evaluating,
    files,
    grading,
    sampling,
    statistics,
    texts,
)

__all__ = ["ORACLES", "QUERIES"]
