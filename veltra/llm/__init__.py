"""Training-data operators: packing, deduplication, archives, filtering, mixing and token files.

Nothing outside this package imports it; ``veltra.llm.queries`` registers the contract queries.
"""
