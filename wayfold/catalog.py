"""All core queries: name -> function of (spark, folder), and name -> SQL with the same result."""

from __future__ import annotations

from wayfold.plans import content, data_prep, evaluation, geo, graphs, guide, merging, pools, search, service, streams, textual, tripgraph, vectors

_MODULES = [data_prep, evaluation, search, merging, pools, vectors, textual, tripgraph, geo, graphs, guide, content, service, streams]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
