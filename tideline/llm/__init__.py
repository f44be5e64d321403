"""Training-data operators: cleaning, deduplication, mixing and packing of documents.

Nothing outside this subpackage imports it; ``queries.py`` is its only public entry.
"""
