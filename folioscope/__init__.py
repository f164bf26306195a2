"""Spark-native engine for bibliographic collections and training-data pipelines."""
