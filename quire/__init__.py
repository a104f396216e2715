"""quire: a PySpark-native engine for document packages."""
