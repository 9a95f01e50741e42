"""Registered queries and the DuckDB SQL that checks them."""

from . import generated, records, stores  # noqa: F401  register their queries
from .queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
