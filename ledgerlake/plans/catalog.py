"""Imports every plan module so that the registry is complete."""

from __future__ import annotations

from ledgerlake.plans import finance, primitives, sales, tables  # noqa: F401
from ledgerlake.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "payables_ageing"


def flagship(spark, sf_dir):
    return QUERIES[FLAGSHIP](spark, sf_dir)
