"""Spark-native regression modelling on market-observation tables."""

__version__ = "0.1.0"
