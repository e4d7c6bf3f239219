"""Queries over the operators, and their oracle SQL."""

from importlib import import_module

AREAS = (
    "filters", "fields", "joins", "aggs", "series", "geometry", "ranking", "sources", "streams",
)


def load():
    """(queries, oracle) with every area registered."""
    for area in AREAS:
        import_module(f"gridspark.plans.{area}")
    from gridspark.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
