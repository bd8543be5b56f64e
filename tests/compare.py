"""Comparing rows of Spark and DuckDB without regard to order."""

from __future__ import annotations

import math

import pandas as pd


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


def assert_same(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> None:
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    ours, theirs = rows_of(spark_frame), rows_of(sql_frame)
    assert len(ours) == len(theirs)
    assert ours == theirs
