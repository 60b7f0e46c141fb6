"""Micro-batch ingest of source files."""
