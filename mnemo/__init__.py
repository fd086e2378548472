"""Part of mnemo, a Spark-native memory engine."""
