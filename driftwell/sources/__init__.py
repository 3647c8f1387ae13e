"""Readers and writers: parquet tables, snapshots, CSV export, JSON cards, model persistence."""
