"""All named queries of the library with their SQL equivalents."""

from __future__ import annotations

from cytofold.plans import cell_queries, level_queries, name_queries, pixel_queries, relief_queries, table_queries

FLAGSHIP = "a01_objects_to_cells"
_MODULES = (level_queries, table_queries, name_queries, pixel_queries, cell_queries, relief_queries)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
