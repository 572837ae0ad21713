"""Registry of the raster queries and of the SQL that each must equal."""

from __future__ import annotations

from .plans import deeper, keys, lengths, reports, scalars, search, spatial, stateful, streams

MODULES = (scalars, keys, lengths, search, spatial, reports, stateful, deeper, streams)
QUERIES = {name: f for m in MODULES for name, f in m.R.queries.items()}
ORACLES = {name: q for m in MODULES for name, q in m.R.oracles.items()}
