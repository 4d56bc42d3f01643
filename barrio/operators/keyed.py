"""Equi-joins on grid, block and site keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None = None) -> DataFrame:
    """Inner equi-join with a further condition.

    It is left to the adaptive planner, which knows the true sizes once the sides are shuffled: it splits the tasks of
    a key that holds much of the data and sends a side around if that side is small. Nothing runs
    while the plan is built, no key is listed, and empty sides are nothing special.
    """
    out = left.join(right, keys)
    return out if condition is None else out.where(condition)


def large_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the input: sorted and merged, never sent around.

    Before a shuffle the planner knows a side by the size of its files only. Tables of counts and repeated words take
    some hundred times their files' size in memory, so a side that looks small would fill the driver as a broadcast.
    """
    return left.join(right.hint("merge"), on, how)
