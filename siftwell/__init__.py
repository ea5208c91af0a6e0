"""Spark-native operators for catalogues of continuously re-observed records."""
