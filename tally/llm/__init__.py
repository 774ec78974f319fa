"""Training-data operators: dedup, quality, scoring, search, packing, mixing.

Nothing else in the library imports this subpackage.
"""
