"""Spark-native analytics over wide sample-by-feature matrices and the tables around them."""
