"""Counts of what goes by in a running query, without a second pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F


def counted(df: DataFrame, observation: Observation, conditions: Mapping[str, Column]) -> DataFrame:
    """The same rows; ``observation`` counts those that meet each condition.

    The figures are there (``observation.get``) after the first action on the result, and they
    are of that action: tasks add them up beside the rows, no job runs for them. Rows that a
    later ``limit`` or filter throws away were counted if a task came to them.
    """
    return df.observe(observation, *[
        F.count(F.when(condition, 1)).alias(name) for name, condition in conditions.items()])
