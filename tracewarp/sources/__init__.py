"""Scans: incident directories, driver tables as telemetry views, converters."""
