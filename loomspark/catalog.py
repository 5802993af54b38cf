"""Every registered query of the general operators, with its SQL."""

from __future__ import annotations

from loomspark.plans import alignments, covers, events, intervals, reads, science, sequences, tables, variants

_PARTS = (tables, intervals, alignments, sequences, science, events, variants, reads, covers)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
FLAGSHIP = "bed_closest"
