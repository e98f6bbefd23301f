"""Readers, sinks, schemas and the shared working folder."""
