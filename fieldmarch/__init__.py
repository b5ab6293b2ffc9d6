"""Spark jobs for fleets of field-safety devices: telemetry, trails, routes, utterances."""
