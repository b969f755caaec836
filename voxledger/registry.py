"""All registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from voxledger.plans import feedback, returns_report, taxonomy_flow, usage_report

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (returns_report, usage_report, feedback, taxonomy_flow):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
