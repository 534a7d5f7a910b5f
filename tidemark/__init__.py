"""Tidemark: a PySpark-native engine for execution and market-microstructure analytics."""

__version__ = "0.1.0"
