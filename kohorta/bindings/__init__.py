"""Registered queries: every operator bound to the given tables, with its check in SQL."""

from kohorta.bindings import (aggregates, evaluation, joins, modeling, pipelines, reshaping, scalars, sources,
                              temporal)
from kohorta.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "evaluation", "joins", "modeling", "pipelines", "reshaping",
           "scalars", "sources", "temporal"]
