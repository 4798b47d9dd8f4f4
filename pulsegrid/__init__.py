"""Tempo, key and catalog analytics as Spark DataFrame plans."""
