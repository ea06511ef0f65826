"""The registered queries of the engine and their SQL."""

from linkloom.plans import filter_queries, pair_queries, probe_queries, text_queries

QUERIES = {**text_queries.QUERIES, **pair_queries.QUERIES, **filter_queries.QUERIES, **probe_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **pair_queries.ORACLES, **filter_queries.ORACLES, **probe_queries.ORACLES}
