"""A PySpark-native engine for reversible de-identification and entity analytics over text."""
