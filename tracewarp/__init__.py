"""Event-time incident analytics on Spark: telemetry views, windows, joins, graphs, inference."""
