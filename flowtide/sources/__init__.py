"""Readers and writers: JSON lines, daily raw flows, the table store."""
