"""Queries for the driver, one or more per operator, with their SQL."""

from docledger.plans.queries import ingest, invoices, jobs, parse, text  # noqa: F401
from docledger.plans.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
