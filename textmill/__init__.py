"""textmill: a Spark-native analytics engine for text corpora."""
