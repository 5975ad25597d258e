"""Spark-native table synchronisation, integrity, listing and command folding."""

__version__ = "0.1.0"
