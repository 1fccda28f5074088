"""Spark-native building blocks for multilingual fact-check claim datasets."""
