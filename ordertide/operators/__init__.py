"""Filters, aggregates, order and the book."""
