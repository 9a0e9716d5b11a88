"""Spark-native correlation of fraud evidence."""
