"""Registered queries: name -> (Spark plan, inventory ids, DuckDB text for the same rows)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    plan: Plan
    covers: str
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan. Output doubles are rounded the same way in Spark and SQL by the author."""

    def add(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return text_times(plan(spark, sf_dir))

        REGISTRY[name] = Entry(run, covers, sql)
        return plan

    return add


def text_times(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that both engines hand over the same scalar."""
    types = dict(df.dtypes)
    return df.select(*[
        F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) if types[n] in ("timestamp_ntz", "timestamp") else F.col(n)
        for n in df.columns])


def rounded(x, digits: int = 6):
    """Round and fold -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)
