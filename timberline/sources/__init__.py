"""Readers and normalisers of log records."""
