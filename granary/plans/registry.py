"""Collects the named queries of the core: name -> callable(spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("packed", "quality", "retrieval", "behaviour", "records", "statistics", "composites", "audit", "profiles", "fields")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"granary.plans.{name}").QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"granary.plans.{name}").ORACLES
    return out
