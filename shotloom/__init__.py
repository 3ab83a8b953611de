"""Spark-native preparation and evaluation of multi-signal, multi-rate time series."""
