"""Security-log analytics as Spark DataFrame operators."""
