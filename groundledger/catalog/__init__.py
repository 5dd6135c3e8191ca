"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ["q_base", "q_features", "q_sources", "q_ordered", "q_scalars", "q_guard",
           "q_verify", "q_speakers", "q_items", "q_voices", "q_sinks", "q_streams"]


def _load():
    from . import registry
    import os

    for m in MODULES:
        if os.path.exists(os.path.join(os.path.dirname(__file__), m + ".py")):
            import_module(f"{__name__}.{m}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
