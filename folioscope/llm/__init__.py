"""Training-data operators: tokens, packing, deduplication, filtering, extraction and search.

Nothing outside this package imports it; its queries are in :mod:`folioscope.llm.registry`.
"""
