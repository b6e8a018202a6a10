"""lodestone: a Spark-native hybrid retrieval engine and training-data toolkit."""
