"""Spark-native engine for building and measuring labelled prompt-safety data."""
