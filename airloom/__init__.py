"""airloom: equipment-telemetry analytics as Spark DataFrame, SQL and Structured Streaming programs."""
