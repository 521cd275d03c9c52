"""Spark-native priority audit of support tickets."""

__version__ = "0.1.0"
