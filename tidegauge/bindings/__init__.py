"""Bindings of the operators to the given tables."""


def load():
    """(queries, sql) of all binding modules."""
    from tidegauge.bindings import association, columns, contracts, distribution, evaluation, models, profile, sources, workflows  # noqa: F401
    from tidegauge.bindings.registry import QUERIES, SQL

    return QUERIES, SQL
