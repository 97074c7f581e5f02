"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

from tabulon.plans import answers, catalog, enrichment, estimates, loaders, records, rules, search, streams, texts

MODULES = (estimates, catalog, search, records, texts, streams, enrichment, answers, loaders, rules)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
