"""Maintenance jobs over the table store.

Those that rewrite day partitions do so through a staged swap and are meant to run
between micro-batches, for instance from the driver that runs the stream.
"""
