"""All registered queries of the raster engine and their SQL oracles."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> f(spark, sf_dir)) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("rasterloom.plans.pixel_queries", "rasterloom.plans.catalog_queries", "rasterloom.plans.image_queries")
FLAGSHIP = "g10_g11_g12_palette"


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= importlib.import_module(m).ORACLES
    return out
