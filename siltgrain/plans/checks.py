"""What an executed plan does, for tests: pushed filters, columns read, Python stages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", text_of(df))


def columns_read(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)", text_of(df))


def runs_python(df: DataFrame) -> bool:
    return bool(re.search("Python|Pandas|InArrow", text_of(df)))
