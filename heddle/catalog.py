"""Every query of the library outside heddle.llm, with its SQL."""

from __future__ import annotations

from .plans import bricks, clinical, details, documents, extras, geometry, headers, json_rules, lumen, measures, mesh, reports, rules, scene, search, sequences, series, sources, state, viewer, voxels

MODULES = (search, series, measures, sequences, voxels, bricks, lumen, scene, geometry, mesh, rules, json_rules, clinical, documents, state, sources, headers, details, viewer, reports, extras)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.CATALOG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.CATALOG.sql.items()}
