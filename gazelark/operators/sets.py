"""Unions, differences and ordered sets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_streams(*streams: DataFrame) -> DataFrame:
    """All rows of all streams, repeats too; a column that a stream lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def except_self(rows: DataFrame, own: DataFrame, column: str = "source") -> DataFrame:
    """rows whose `column` isn't in own's; a row without one is nobody's own and stays."""
    return rows.join(own.select(column).distinct(), column, "left_anti")


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, values: each group's distinct values as an array, by their first place in `order`.

    Repeats are gone before the array is made, so it is as long as a group has distinct values.
    """
    first = rows.groupBy(group, value).agg(F.min(order).alias("_gz_first"))
    listed = F.array_sort(F.collect_list(F.struct("_gz_first", value)))
    return first.groupBy(group).agg(F.transform(listed, lambda x: x[value]).alias("values"))
