"""The registered queries of the retrieval operators and their SQL. Whole numbers leave as longs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans import graph_queries, retrieval_queries, text_queries


def _longs(query):
    @functools.wraps(query)
    def run(spark, sf_dir) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])

    return run


_MODULES = (text_queries, retrieval_queries, graph_queries)
QUERIES: dict = {k: _longs(f) for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
