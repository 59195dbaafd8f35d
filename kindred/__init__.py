"""Spark-native record linkage: normalise, block, compare, match, evaluate, validate."""

__version__ = "0.1.0"
