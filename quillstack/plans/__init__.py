"""Operators composed into whole flows: search, ingestion, web ingestion."""
