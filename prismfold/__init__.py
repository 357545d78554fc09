"""A PySpark-native engine for large collections of one-dimensional spectra."""
