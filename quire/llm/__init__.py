"""Training-data operators: filtering, deduplication, mixing, sharding, packing and language-model scoring.

Nothing else in the library imports this subpackage.
"""
