"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

import importlib

PARTS = ("q_windows", "q_geo", "q_text", "q_data", "q_flows")


def _parts():
    return [importlib.import_module(f"voltlake.plans.{name}") for name in PARTS]


def queries() -> dict:
    return {k: f for p in _parts() for k, f in p.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _parts() for k, s in p.S.items()}
