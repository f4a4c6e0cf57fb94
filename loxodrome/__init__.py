"""Loxodrome: point-pattern and training-data analytics as Spark DataFrame operators."""
