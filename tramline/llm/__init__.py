"""Training-data operators: packing, token files, extraction, filters, deduplication, scoring.

Each module holds one operator with its own interface; ``catalog`` holds the thin queries
that apply them to the shared tables. Nothing outside this subpackage imports it.
"""
