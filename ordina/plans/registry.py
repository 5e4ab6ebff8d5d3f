"""Registered queries: a Spark form over the driver's tables and, where SQL can say it, its oracle.

Doubles are rounded to four digits on both sides, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.plans import inputs

KEY = ["track"]
DIGITS = 4


@dataclass(frozen=True)
class Query:
    """columns: names; `:d` marks doubles. sql: None where SQL can't say it."""

    columns: str
    run: Callable[[Callable[[str], DataFrame], SparkSession, str], DataFrame]
    sql: str | None = None

    def fields(self) -> list[tuple[str, bool]]:
        return [(c.removesuffix(":d"), c.endswith(":d")) for c in self.columns.split()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = self.run(lambda name: inputs.series(spark, sf_dir, name), spark, sf_dir)
        return rows.select(*[(F.round(F.col(c), DIGITS) + 0.0).alias(c) if d else F.col(c) for c, d in self.fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        picked = ", ".join(f'round("{c}", {DIGITS}) + 0.0::DOUBLE AS "{c}"' if d else f'"{c}"' for c, d in self.fields())
        return f"SELECT {picked} FROM ({inputs.oracle(self.sql)}) q"


QUERIES: dict[str, Query] = {}


def add(name: str, columns: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = Query(columns, run, sql)
        return run

    return register
