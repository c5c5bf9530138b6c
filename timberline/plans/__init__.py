"""Queries over the driver tables, with SQL for each."""
