"""Power-outage analytics as Spark DataFrame operators."""
