"""Operators for training-data pipelines: packing, filters, deduplication, tokenizing, search, fixity."""
