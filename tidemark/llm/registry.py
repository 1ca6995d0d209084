"""Queries of the training-data operators, one thin query for each."""

from __future__ import annotations

from . import contracts


def queries():
    return dict(contracts.QUERIES)


def oracle_sql():
    return dict(contracts.ORACLES)
