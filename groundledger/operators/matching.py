"""Greedy one-to-one matching in rounds, without a list per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import settle


def greedy_matching(edges: DataFrame, keys: list[str], left: str, right: str, order: Column) -> DataFrame:
    """The edges that a walk in ``order`` would take, each ``left`` and each ``right`` at most once per ``keys``.

    An edge that is the first one of its left and of its right end is taken by the walk whatever happens elsewhere; the other
    edges at its ends are not. So all such edges are taken at once, their ends leave, and the rest goes into the next round.
    ``order`` must tell all edges of ``keys`` apart.
    """
    rest = edges.withColumn("_order", order)
    taken = None
    while True:
        first_left = rest.groupBy(*keys, left).agg(F.min("_order").alias("_l"))
        first_right = rest.groupBy(*keys, right).agg(F.min("_order").alias("_r"))
        told = settle(rest.join(first_left, [*keys, left]).join(first_right, [*keys, right]).withColumn(
            "_take", (F.col("_order") == F.col("_l")) & (F.col("_order") == F.col("_r"))).drop("_l", "_r"))
        won = told.where("_take")
        taken = won if taken is None else taken.unionByName(won)
        lost = told.where(~F.col("_take")).join(won.select(*keys, left), [*keys, left], "left_anti").join(
            won.select(*keys, right), [*keys, right], "left_anti")
        if lost.isEmpty():
            return taken.select(*edges.columns)
        rest = lost.drop("_take")
