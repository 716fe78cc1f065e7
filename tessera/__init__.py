"""tessera: a PySpark-native engine for company-intelligence analytics."""
