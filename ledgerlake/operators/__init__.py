"""All finance queries; importing this package registers them."""

from ..plans.registry import ORACLE_SQL, QUERIES
from ..streaming import queries as streaming
from . import audit, budget, debt, economic, ingest, lookups, mentions, names, nested, parsers, parsing, parsing_more, reports, tables

__all__ = ["ORACLE_SQL", "QUERIES", "audit", "budget", "debt", "economic", "ingest", "lookups", "mentions", "names", "nested", "parsers", "parsing", "parsing_more", "reports", "streaming", "tables"]
