"""Seasonal climate analytics expressed as Spark DataFrame plans."""
