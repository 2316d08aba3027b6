"""Spark-native repair, statistics and evaluation of text corpora."""
