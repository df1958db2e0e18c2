"""Process-telemetry analytics expressed as Spark plans."""
