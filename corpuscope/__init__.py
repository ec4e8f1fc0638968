"""Spark-native search over text corpora and change histories."""
