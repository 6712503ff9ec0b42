"""Readers and writers: Parquet, JSON lines, broker CSV exports."""
