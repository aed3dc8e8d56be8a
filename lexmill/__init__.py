"""lexmill: Spark-native corpus, retrieval and evaluation analytics."""
