"""Stage weights, progress and job state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C


def overall_progress(stage: Column, within: Column) -> Column:
    """Share of the weighted stages that is done, in [0, 1]."""
    total = sum(w for _, w in C.STAGES)
    done = 0
    pairs = []
    for name, w in C.STAGES:
        pairs.append((name, done, w))
        done += w
    before = F.create_map(*[F.lit(x) for n, b, _ in pairs for x in (n, b)])
    weight = F.create_map(*[F.lit(x) for n, _, w in pairs for x in (n, w)])
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), within))
    value = (F.try_element_at(before, stage) + F.try_element_at(weight, stage) * part) / total
    return (
        F.when(stage == "completed", 1.0)
        .otherwise(F.coalesce(F.bround(F.least(F.lit(1.0), value), 3), F.lit(0.0)))
    )
