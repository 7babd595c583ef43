"""All queries of the library; importing a module of queries registers them."""

from __future__ import annotations

from . import function_queries, kernel_queries, scene_queries, spatial_queries, terrain_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
