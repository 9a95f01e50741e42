"""A PySpark-native engine for retrieval-augmented review analysis and its evaluation."""
