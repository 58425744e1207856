"""Scans, sinks and the table catalog."""
