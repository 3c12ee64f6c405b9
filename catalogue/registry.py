"""All registered queries and their oracles."""

from __future__ import annotations

from catalogue import building, exporting, files, history, incremental, locating, matching, review

QUERIES, ORACLES = {}, {}
for module in (matching, review, history, building, exporting, locating, files, incremental):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
