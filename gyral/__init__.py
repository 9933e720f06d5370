"""gyral: a Spark-first engine for retrieval, mask, grid and training-data analytics."""

__version__ = "0.1.0"
