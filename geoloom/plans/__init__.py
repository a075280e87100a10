"""Runnable queries over derived tables, and whole-map pipelines."""

from importlib import import_module

MODULES = ["network_queries", "scalar_queries", "polygon_queries", "join_queries", "raster_queries", "stream_queries", "source_queries"]


def all_queries():
    """(queries, oracle SQL) of every module."""
    from geoloom.plans import registry

    for name in MODULES:
        import_module(f"geoloom.plans.{name}")
    return registry.QUERIES, registry.ORACLES
