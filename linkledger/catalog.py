"""All queries of the library by name, with the SQL that each must agree with."""

from __future__ import annotations

from .operators import addresses, changes, controls, discovery, links, merges, messages, migration, names, redaction, reports, rule_tables, rules, scans, similarity, snapshots, trees, usage, values, visits
from .plans import crawl
from .sources import files, states
from .streaming import event_log

_MODULES = (links, names, changes, visits, rules, rule_tables, reports, migration, similarity, redaction, trees, scans, discovery, messages, snapshots, usage, addresses, values, merges, controls, crawl, event_log, files, states)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
