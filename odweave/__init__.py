"""odweave: a Spark-native engine for origin-destination and human-mobility analytics."""
