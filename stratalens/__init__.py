"""A PySpark-native engine that treats files as tables of segments, findings and reports."""

__version__ = "0.1.0"
