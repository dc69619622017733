"""Registered queries over the library's operators, and the same in SQL."""

from quire.plans import kernels, relational, scalars, structure
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["oracles", "queries", "kernels", "relational", "scalars", "structure"]


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
