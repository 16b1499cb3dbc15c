"""Spark-native spectral, spatial and tabular analytics."""
