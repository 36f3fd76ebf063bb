"""tessera: a PySpark-native document and data-processing engine."""
