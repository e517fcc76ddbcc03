"""Media-archive analytics as Spark DataFrame operators."""
