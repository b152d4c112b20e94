"""Framewright: a PySpark-native engine for the data side of multi-camera episode corpora."""

__version__ = "0.1.0"
