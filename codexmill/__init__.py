"""codexmill: a Spark-native analytics engine for corpora of digital publications."""
