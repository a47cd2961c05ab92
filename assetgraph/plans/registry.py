"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from assetgraph.plans import catalog, extract, forms, graph, ingest, streams, surface

MODULES = (ingest, catalog, extract, forms, graph, streams, surface)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
