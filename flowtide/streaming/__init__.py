"""Continuous ingest of JSON-lines files into the table store."""
