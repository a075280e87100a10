"""Operators for training-data pipelines: scans, filters, deduplication, mixing and token files."""
