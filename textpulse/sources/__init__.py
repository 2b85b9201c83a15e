"""Readers and writers: items, articles, captured pages, derived tables."""
