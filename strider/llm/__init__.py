"""Operators of a training-data pipeline: filters, near-duplicates, mixing, packing, archives, search.

Nothing outside this package imports it. Every operator takes and returns DataFrames; the thin
``opN_*`` queries that fix its parameters for the shared tables are in :mod:`strider.llm.queries`.
"""
