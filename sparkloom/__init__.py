"""PySpark-native analytics over versioned knowledge, text corpora and event journals."""
