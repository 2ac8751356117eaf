"""Statement-of-work analytics as Spark DataFrame operators."""
