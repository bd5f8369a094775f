"""Runs SQL over the Parquet tables of a folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.dialect import DUCK, SPARK, Dialect
from tidemark.plans.views import TABLES, with_views

Query = Callable[[Dialect], str]


def spark_query(make: Query) -> Callable[[SparkSession, str], DataFrame]:
    """A function of (spark, sf_dir). Tables are bound as DataFrames, so nothing is registered in the session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = with_views(make(SPARK), SPARK)
        used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
        if not frames:
            return spark.sql(sql)
        escaped = sql.replace("{", "{{").replace("}", "}}")
        return spark.sql(re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(TABLES)})\b", r"\1\2{\3}", escaped), **frames)

    run.__doc__ = make.__doc__
    return run


def duck_sql(make: Query) -> str:
    return with_views(make(DUCK), DUCK)


def both(queries: dict[str, Query]) -> tuple[dict, dict[str, str]]:
    return {k: spark_query(v) for k, v in queries.items()}, {k: duck_sql(v) for k, v in queries.items()}
