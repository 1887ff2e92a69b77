"""The report queries. Each takes a table source and returns a lazy DataFrame.

A table source offers ``conversations(low, high)``, ``statistics(low, high)``,
``rollup(name, low, high)`` (bounds on the bucket), ``newest_bucket()`` and the
naming tables as attributes: ``sources.store.TableStore`` reads them,
``sources.derived.DerivedTables`` computes them from flows.
"""
