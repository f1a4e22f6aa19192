"""mnemospark: a PySpark-native engine for bi-temporal, provenance-carrying memory tables."""
