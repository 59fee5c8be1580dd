"""A PySpark-native engine for retrieval, evidence and document analytics."""

__version__ = "0.1.0"
