"""Ingest of raw tables into corpus tables, and reading them back."""
