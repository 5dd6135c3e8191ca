"""Stages that run again only for what changed.

A ledger holds for each stage and key the hash of the input that the stored result was made from. A stage takes the keys whose input
has another hash, replaces their results in one step, and then enters the new hashes; if it is killed before that, it does the same
again, so results and ledger never disagree for long and never to the harm of a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import settle
from ..sources import versions


def input_hash(rows: DataFrame, by: str) -> DataFrame:
    """``by, hash``: two sums of row hashes and the number of rows, so the order of rows doesn't matter but repeated rows do."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(by).agg(F.concat_ws(":", total(1), total(2), F.count(F.lit(1)).cast("string")).alias("hash"))


def run_stage(spark: SparkSession, path: str, stage: str, rows: DataFrame, by: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``work`` for all keys of ``rows``, made anew only for keys with changed rows.

    ``work`` gets the rows of these keys and returns rows with the column ``by``; what it returns for a key must depend on the rows of
    that key alone. Results lie in ``path``/``stage``, hashes in ``path``/ledger-``stage``. Keys that left ``rows`` lose their results.
    """
    hashes = settle(input_hash(rows, by))
    known = _ledger(spark, path, stage, by)
    same = lambda a, b: a[by].eqNullSafe(b[by])
    if known is None:
        todo, gone = hashes, hashes.select(by)
    else:
        todo = settle(hashes.join(known, same(hashes, known) & (hashes["hash"] == known["hash"]), "left_anti"))
        left = known.join(hashes, same(known, hashes), "left_anti").select(by)
        gone = settle(todo.select(by).unionByName(left))
    if known is None or not gone.isEmpty():
        changed = rows.join(todo.select(F.col(by).alias("_todo")), rows[by].eqNullSafe(F.col("_todo")), "left_semi")
        versions.replace_keys(work(changed), f"{path}/{stage}", by, gone)
        versions.replace_keys(todo.withColumn("stage", F.lit(stage)), f"{path}/ledger-{stage}", by, gone)
    return versions.read_current(spark, f"{path}/{stage}", by)


def _ledger(spark: SparkSession, path: str, stage: str, by: str) -> DataFrame | None:
    try:
        return settle(versions.read_current(spark, f"{path}/ledger-{stage}", by))
    except FileNotFoundError:
        return None
