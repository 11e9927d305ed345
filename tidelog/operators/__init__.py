"""Validation, filters, pages, bucket counts, summaries, ids and retention of logs."""
