"""Recovery and fleet analytics as PySpark DataFrame functions."""
