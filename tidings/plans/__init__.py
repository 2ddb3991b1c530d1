"""Composite pipelines, and the catalog of queries over the test tables."""
