"""A PySpark-native engine for tabular data preparation and its evaluation."""
