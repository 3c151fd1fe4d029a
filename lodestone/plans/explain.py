"""What a plan will do, as text and as operator names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def operators(df: DataFrame) -> list[str]:
    """Physical operators from the root down, before adaptive changes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-|*()0-9]*([A-Z]\w+)", line))]
