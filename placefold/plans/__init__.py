"""Registered queries: a Spark plan and the SQL it must agree with."""

from __future__ import annotations

from . import delivery, jobs, merges, scans, spatial, streams, tasks, texts

GROUPS = (scans, texts, merges, jobs, tasks, spatial, delivery, streams)


def registered() -> dict[str, tuple]:
    """Query name to (plan, oracle SQL)."""
    found: dict[str, tuple] = {}
    for group in GROUPS:
        found.update(group.QUERIES)
    return found
