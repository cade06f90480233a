"""A PySpark-native engine for text packages, vocabularies, evidence and nested documents."""
