"""All registered packet queries."""

from .catalog import QUERIES as _BASE
from .catalog import flagship
from .details import QUERIES as _DETAILS

QUERIES = _BASE | _DETAILS
__all__ = ["QUERIES", "flagship"]
