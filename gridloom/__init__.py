"""gridloom: a PySpark-native engine for image feature libraries and similarity matching."""
