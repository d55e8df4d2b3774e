"""annulus: a Spark-native engine for round-robin time-series history."""
