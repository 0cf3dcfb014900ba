"""Registered queries, by family. Each registry has queries() and oracle_sql()."""

from . import decisions, normalising, relational, retrieval, selecting

REGISTRIES = [retrieval, decisions, normalising, relational, selecting]
