"""Wires operators to the given tables; one module per area."""

from __future__ import annotations

import importlib

_AREAS = ("catalog", "backups", "precedents", "issues", "sheets", "streams", "cells", "drawings", "spelling")


def _load():
    for area in _AREAS:
        importlib.import_module(f"recordqc.plans.{area}")


def queries():
    from recordqc.plans import registry
    _load()
    return dict(registry.QUERIES)


def oracles():
    from recordqc.plans import registry
    _load()
    return dict(registry.ORACLES)
