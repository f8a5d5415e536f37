"""textloom: building, searching and evaluating technical-text corpora on Spark."""

__version__ = "0.1.0"
