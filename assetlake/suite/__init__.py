"""Every operator on the driver tables, next to the SQL that must give the same rows."""

from . import files, gates, markup, pixels, queue, scalars, streams  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
