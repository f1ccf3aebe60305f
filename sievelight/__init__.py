"""Spark-native preparation, leakage audit and evaluation of labelled text datasets."""
