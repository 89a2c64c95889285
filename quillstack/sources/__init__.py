"""Readers, exporters and versioned Parquet snapshots."""
