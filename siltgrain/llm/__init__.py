"""Training-data operators: scoring, packing, tokenising, deduplication, scans and vector search.

Nothing else in the library imports this subpackage. Each module holds one operator with its general interface; ``queries`` derives the registered
digest queries from them.
"""
