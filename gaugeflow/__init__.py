"""gaugeflow: structural time-series analytics as Spark DataFrame operators."""
