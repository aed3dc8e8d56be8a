"""Registered queries and their SQL twins."""

from lexmill.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
