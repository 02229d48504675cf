"""The query catalogue of the core: what ``queries()`` and ``oracle_sql()`` hand out."""

from __future__ import annotations

from shelfmark.plans import linkage, monitoring, tagging

QUERIES = linkage.QUERIES | monitoring.QUERIES | tagging.QUERIES
ORACLES = linkage.ORACLES | monitoring.ORACLES | tagging.ORACLES
FLAGSHIP = "dedup_mapping"
