"""Registered queries (one per SURVEY §2 operator) and their SQL oracles."""

from .registry import REGISTRY, Entry, query  # noqa: F401
from . import q_imputation, q_basic, q_joins, q_aggregates, q_windows, q_timeseries, q_reshape, q_forecast, q_domain  # noqa: F401,E402,I001


def queries():
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql():
    return {k: e.oracle() for k, e in REGISTRY.items() if e.sql is not None}
