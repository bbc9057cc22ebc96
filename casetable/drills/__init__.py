"""Queries over the test tables, one or more per operator, with their SQL checks."""

from __future__ import annotations


def _load() -> None:
    from casetable.drills import (  # noqa: F401
        cell_drills, io_drills, join_drills, order_drills, plan_drills, run_drills, scoring_drills, table_drills,
    )


def all_queries() -> dict:
    from casetable.drills.base import QUERIES

    _load()
    return dict(sorted(QUERIES.items()))


def all_checks() -> dict[str, str]:
    from casetable.drills.base import CHECKS

    _load()
    return dict(sorted(CHECKS.items()))
