"""Readers and writers: dirty CSV ingest, layer storage, report export, model storage."""
