"""Click and ranking analytics as PySpark DataFrame operators."""
