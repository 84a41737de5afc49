"""Ranks and top-k within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group with their rank from 1; the planner prunes groups before and after the shuffle."""
    return ranked(rows, by, order, name).filter(F.col(name) <= k)
