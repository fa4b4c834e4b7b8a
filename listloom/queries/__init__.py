"""Registered queries and their plain-SQL counterparts.

Each query reads whole tables and has an equivalent in SQL over the same tables,
written without any operator of this package.
"""

from listloom.queries import listings, logs, names, pages, shops, sizes, streams, texts, variants
from listloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "listings", "logs", "names", "pages", "shops", "sizes", "streams", "texts", "variants"]
