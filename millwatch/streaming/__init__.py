"""Structured Streaming forms of the telemetry roll-ups and the alert scoring."""
