"""Every operator as a query over the driver tables, each with its SQL counterpart."""

from . import crosssection, fundamental, macro, market, model, normalise, panel, tables  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
