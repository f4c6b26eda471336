"""Queries over the driver tables and their SQL counterparts."""

from . import graph, quality, records, relate, sources, state, windows  # noqa: F401  the imports register their queries
