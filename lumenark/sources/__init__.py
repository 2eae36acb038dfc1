"""Schemas, readers and the enriched inventory relation."""
