"""quarrylink: Spark-first record linkage and training-data preparation."""

__version__ = "0.1.0"
