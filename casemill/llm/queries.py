"""Queries of the training-data operators, and SQL where it can express them on whole tables."""

from __future__ import annotations

import importlib

#: modules that define QUERIES and ORACLES
MODULES = ("q_splits", "q_pieces", "q_mixing", "q_leaks", "q_nearest", "q_near_copies", "q_names", "q_sentences", "q_scans")


def _each(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"casemill.llm.{m}"), what).items()}


def queries() -> dict:
    return _each("QUERIES")


def oracle_sql() -> dict:
    return _each("ORACLES")
