"""Readers, schemas and ingestion of text sources."""
