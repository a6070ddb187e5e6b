"""Scans, sinks and vendor payloads."""
