"""All queries of the library proper and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import queries_corpus, queries_retrieval

_MODULES = (queries_retrieval, queries_corpus)


def _wide(query: Callable) -> Callable:
    """The query with its integers as longs, as SQL engines differ in the width of counts."""

    def run(spark, sf_dir) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind == "int" else F.col(f"`{c}`") for c, kind in df.dtypes])

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict:
    return {name: _wide(q) for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items() if name in m.QUERIES}
