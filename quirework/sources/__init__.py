"""Readers: parquet tables, EPUB archives, labelled sample files."""
