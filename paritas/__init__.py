"""Classifier-bias analytics as Spark DataFrame operators."""
