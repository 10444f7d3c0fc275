"""Table bindings, named queries and oracle SQL."""


def all_queries():
    """(queries, oracles) of every query module."""
    from barloom.plans import composed_queries, evaluation_queries, feature_queries, refit_queries, registry, source_queries, study_queries, trade_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLES
