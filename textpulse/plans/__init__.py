"""Corpora, batch jobs and registered queries."""
