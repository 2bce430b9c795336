"""queries() and oracle_sql(): one entry per operator, on the driver's tables as domain views."""

from __future__ import annotations

from collections.abc import Callable

from placerec.plans import evaluation, maps, pointwise, relational, retrieval, trajectories

MODULES = (pointwise, maps, retrieval, trajectories, evaluation, relational)


def queries() -> dict[str, Callable]:
    from placerec.streaming import plans as streaming

    return {name: f for m in (*MODULES, streaming) for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
