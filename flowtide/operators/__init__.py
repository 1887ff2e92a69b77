"""Aggregations, filters, joins and orderings over flow tables."""
