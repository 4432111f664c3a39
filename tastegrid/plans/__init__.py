"""Registered queries and the SQL that defines their results."""

from tastegrid.plans import cleaning, evaluation, predictions, profiling, similarities

_FAMILIES = [cleaning, profiling, similarities, predictions, evaluation]
QUERIES = {name: fn for m in _FAMILIES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _FAMILIES for name, sql in m.ORACLES.items()}
flagship = QUERIES["cf_pipeline"]
