"""A Spark-native engine for evaluating free-form answers against a label taxonomy."""
