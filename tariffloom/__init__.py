"""Spark-native checking, building and reconciling of tariff tables."""

__version__ = "0.1.0"
