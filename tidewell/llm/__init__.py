"""Training-data operators: token files, archives, deduplication, decontamination, scoring, packing.

Nothing else in the library imports this subpackage; ``llm.queries`` registers its queries.
"""
