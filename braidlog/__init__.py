"""braidlog: a PySpark-native engine for multi-node server logs."""
