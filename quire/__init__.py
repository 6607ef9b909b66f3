"""quire: a PySpark engine for paged, self-describing tables."""

__version__ = "0.1.0"
