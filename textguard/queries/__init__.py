"""The registered queries: every operator over the given tables, with a SQL twin where there is one."""

from textguard.queries import catalog_corpus, catalog_events, catalog_text  # noqa: F401
from textguard.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
