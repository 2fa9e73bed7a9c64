"""Registered queries by topic."""

from __future__ import annotations

import importlib

TOPICS = ("connectome", "cohort", "statistics", "models", "storage", "reporting")


def load_all():
    """Import every topic and return (queries, oracles)."""
    for topic in TOPICS:
        importlib.import_module(f"neurospan.plans.{topic}")
    from neurospan.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
