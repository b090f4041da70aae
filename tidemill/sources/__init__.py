"""Readers: parquet, JSON, delimited text, zip archives, and the catalog."""
