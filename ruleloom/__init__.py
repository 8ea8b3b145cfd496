"""Spark-native corpus and rule analytics."""
