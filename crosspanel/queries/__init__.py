"""Every query and its SQL, registered by module."""

from . import accounts, evaluation, features, joins, labels, monitoring, tables  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
