"""The named queries over the given tables and their SQL counterparts."""

from .oracle import ORACLE
from .queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
