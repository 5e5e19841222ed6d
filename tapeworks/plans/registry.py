"""All registered queries and their SQL: a name for each operator it exercises, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import with_views

FLAGSHIP = "e5_market_pnl"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, doubles: str = "", places: int = 6):
    """Registers query(spark, sf_dir). `doubles` are columns rounded to `places` on both sides, so that sums in another order compare equal."""

    def keep(query):
        cols = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = query(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in cols}) if cols else df

        run.__doc__ = query.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            body = with_views(sql)
            if cols:
                body = f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) + 0.0 AS {c}' for c in cols)}) FROM ({body})"
            ORACLE_SQL[name] = body
        return query

    return keep


from . import feature_queries, fill_queries, level_queries, source_queries, stats_queries, stream_queries, vol_queries  # noqa: E402, F401
