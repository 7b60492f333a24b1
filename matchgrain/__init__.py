"""Two-sided match analytics as Spark DataFrame plans."""
