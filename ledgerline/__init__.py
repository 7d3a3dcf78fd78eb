"""ledgerline: a PySpark-native analytics engine for large document and control collections."""
