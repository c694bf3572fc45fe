"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in MODULES if m.SQL}
