"""millrace: a PySpark-native engine for columnar, time-series, search and text queries."""
