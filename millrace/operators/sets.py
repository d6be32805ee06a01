"""Bag unions. Every source counts once, the first included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, others, first)


union_multi = union_local = union


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def concatenate(sources: list[DataFrame]) -> DataFrame:
    if not sources:
        raise ValueError("no sources")
    return reduce(DataFrame.unionByName, sources)


def widened(first: DataFrame, second: DataFrame) -> DataFrame:
    """Data sets whose columns differ: what one lacks is null."""
    return first.unionByName(second, allowMissingColumns=True)
