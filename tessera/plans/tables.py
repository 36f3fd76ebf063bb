"""Registration of queries that are SQL text over the driver's tables; @name stands for a table."""

from __future__ import annotations

import re

from tessera.catalog import register


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers text as a Spark query, and oracle (or, without one, the same text) as its DuckDB form."""

    def run(spark, sf_dir: str):
        return spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))

    run.__name__ = name
    register(name, re.sub(r"@(\w+)", r"\1", oracle or text))(run)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
