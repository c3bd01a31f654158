"""A registered query: the Spark side, the SQL side, and one column list that shapes both alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import VIEWS_SQL

SPARK_TYPES = {"s": "string", "d": "date", "i": "bigint", "b": "boolean"}
SQL_TYPES = {"s": "VARCHAR", "d": "DATE", "i": "BIGINT", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Case:
    """`columns` is a text such as `"sitename:s date:d obs:f z:f9"`.

    s, d, i and b are text, date, integer and boolean. f is a number rounded to 6 digits, f9 to 9:
    both engines add floats in their own order. A thousandth of the last digit is added before
    rounding, so that values that end in a 5 there round alike.
    """

    columns: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def _fields(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def frame(self, spark: SparkSession, sf: str) -> DataFrame:
        return self.build(spark, sf).select(*[self._spark(n, t).alias(n) for n, t in self._fields()])

    @staticmethod
    def _spark(name: str, kind: str) -> Column:
        if kind in SPARK_TYPES:
            return F.col(name).cast(SPARK_TYPES[kind])
        digits = int(kind[1:] or 6)
        value = F.round(F.col(name).cast("double") + F.lit(1.37 * 10.0 ** -(digits + 3)), digits)
        return F.when(value == 0, F.lit(0.0)).otherwise(value)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        fields = ", ".join(f"{self._duck(n, t)} AS {n}" for n, t in self._fields())
        return f"WITH {VIEWS_SQL.strip()}\nSELECT {fields}\nFROM ({self.sql.strip()}) AS answer"

    @staticmethod
    def _duck(name: str, kind: str) -> str:
        if kind in SQL_TYPES:
            return f"CAST({name} AS {SQL_TYPES[kind]})"
        digits = int(kind[1:] or 6)
        value = f"round(CAST({name} AS DOUBLE) + CAST({1.37 * 10.0 ** -(digits + 3)!r} AS DOUBLE), {digits})"
        return f"CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END"
