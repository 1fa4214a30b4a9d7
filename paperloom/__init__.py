"""A Spark-native engine that turns document corpora into searchable, classified material and assessments."""
